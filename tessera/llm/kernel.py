"""Array kernels over UTF-8 bytes shared by the text operators.

Texts arrive as Arrow string columns.  The kernels work on the raw value buffer
(one ``uint8`` array plus document offsets), so no Python string is made per
document or per word.  A null text is an empty one everywhere.

``chunks`` hands out whole documents, about ``target`` bytes at a time, which
bounds the temporary arrays; only a single document longer than that makes a
larger chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)

#: ASCII white space: blank and \t..\r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True

#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = False
ALNUM[0x3A:0x61] = False
ALNUM[0x7B:0x80] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _table(seed: int) -> np.ndarray:
    return mix((np.arange(1, 257, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


BYTE_CODE = _table(1)
BYTE_CODE_LOWER = BYTE_CODE[LOWER]

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, 1 << 16), U64)
        have[1:] = U64(base & 0xFFFFFFFFFFFFFFFF)
        np.cumprod(have, out=have)
        _powers[base] = have
    return have[:n]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Value bytes and document offsets of an Arrow string or binary array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    big = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    width = np.int64 if big else np.int32
    buffers = column.buffers()
    n = len(column)
    if n == 0 or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(buffers[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offs[0] : offs[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(offs: np.ndarray, target: int = 1 << 20):
    """(first, last) document ranges of about ``target`` bytes each."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + target, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray):
    """Start and end byte of each maximal run of ``inside`` bytes, cut at
    document borders, and the word offsets of the documents."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    w = inside[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    starts = np.flatnonzero(w & (~before | first[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    ends = np.flatnonzero(w & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def prefix_hash(data: np.ndarray, code: np.ndarray = BYTE_CODE) -> np.ndarray:
    """H with H[j]-H[i] = sum of code(byte k) * B**k for i <= k < j, modulo 2**64."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(code[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of data[start:end], the same wherever the bytes stand."""
    return (prefix[ends] - prefix[starts]) * powers(_BASE_INV, len(prefix))[starts]


def word_hashes(data, starts, ends, code=BYTE_CODE_LOWER) -> np.ndarray:
    """A mixed 64-bit hash of each word (A-Z lower-cased) that also holds its length."""
    return mix(span_hash(prefix_hash(data, code), starts, ends) + (ends - starts).astype(U64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i:i+k] for each i; the last k-1 places are left out."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out += words[j : j + n] * U64((0xD1342543DE82EF95 * (2 * j + 1) + k) & 0xFFFFFFFFFFFFFFFF | 1)
    return mix(out)


def owners(offs: np.ndarray, n: int | None = None) -> np.ndarray:
    """The group of each item, from group offsets."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))
