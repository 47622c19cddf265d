"""Token counts of the offline embedding by hash bucket, per key.

Each text is counted where it is read and travels as one row of its own buckets,
not as a row for each of its words.  Rows of a key are added up in order of the
keys, so a task holds one key's sums at a time, however many rows a key has.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.batches import PIECE_ROWS, pieces
from ..functions.text import FNV_PRIME, FNV_SEED, MOCK_DIM

# A token's bytes as they are hashed; 0 where a byte belongs to no token.
_CODE = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyz":
    _CODE[_c] = _CODE[ord(chr(_c).upper())] = _c

# Characters outside ASCII whose lower case has a letter from a to z.
_LOWERED = {"\u212a": "k", "\u0130": "i\u0307"}

_CELL = np.dtype([("bucket", "u1"), ("n", "<u4")])
_TOGETHER = 64  # bytes of a token that are hashed with those of all others


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and where each begins, with the end at last."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    for odd, plain in _LOWERED.items():
        texts = pc.replace_substring(texts, odd, plain)
    at = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    size = int(at[-1] - at[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, int(at[0])) if size else np.zeros(0, np.uint8)
    return data, at - at[0]


def token_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every token.  A bucket is the hash's lowest byte, which
    depends on the lowest bytes alone, as bits move only upwards in a product."""
    data, at = _bytes(texts)
    code = _CODE[data]
    inside = np.zeros(len(code) + 2, bool)
    inside[1:-1] = code > 0
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(code))]
    begins[cut] = code[cut] > 0
    ends[cut - 1] = code[cut - 1] > 0
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    short = np.minimum(last - first, _TOGETHER).astype(np.uint8)
    by = np.argsort(short, kind="stable")[::-1]
    start = first[by]
    live = len(by) - np.cumsum(np.bincount(short, minlength=_TOGETHER + 1))
    h = np.full(len(by), FNV_SEED & 255, np.uint8)
    prime = np.uint8(FNV_PRIME & 255)
    for t, n in enumerate(live[:-1].tolist()):
        h[:n] = (h[:n] ^ code[start[:n] + t]) * prime
    for i in np.flatnonzero((last - first)[by] > _TOGETHER).tolist():
        own = int(h[i])
        for u in code[start[i] + _TOGETHER : last[by[i]]].tobytes():
            own = (own ^ u) * int(prime) & 255
        h[i] = own
    return np.searchsorted(at[1:], start, "right"), h


def _codes(keys: pa.Array) -> np.ndarray:
    """Equal keys as equal numbers, counted from 0 as they come; null is a key."""
    return keys.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)


def count_batches(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """(key, text) batches to (key, cells): the buckets that a key's texts fill, once
    a key and piece; texts without tokens give no row."""
    for part in (p for batch in batches for p in pieces(batch, 1)):
        text, bucket = token_buckets(part.column(1))
        key = _codes(part.column(0))
        n = np.bincount(key[text] * MOCK_DIM + bucket)
        filled = np.flatnonzero(n)
        cells = np.empty(len(filled), _CELL)
        cells["bucket"], cells["n"] = filled % MOCK_DIM, n[filled]
        group, size = np.unique(filled // MOCK_DIM, return_counts=True)
        at = np.concatenate([[0], np.cumsum(size * _CELL.itemsize)]).astype(np.int32)
        packed = pa.Array.from_buffers(pa.binary(), len(group), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(cells.tobytes())])
        where = np.unique(key, return_index=True)[1][group]
        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(where)), packed], names=names)


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(keys, counts by bucket) of sorted (key, cells) batches, each key once."""
    last, held = None, None
    for batch in batches:
        for begin in range(0, batch.num_rows, PIECE_ROWS):
            part = batch.slice(begin, PIECE_ROWS)
            size = pc.binary_length(part.column(1)).to_numpy(zero_copy_only=False) // _CELL.itemsize
            cells = np.frombuffer(b"".join(part.column(1).to_pylist()), _CELL)
            key = _codes(part.column(0))
            groups = int(key[-1]) + 1
            n = np.bincount(np.repeat(key, size) * MOCK_DIM + cells["bucket"], cells["n"], groups * MOCK_DIM).reshape(groups, MOCK_DIM)
            keys = part.column(0).take(pa.array(np.unique(key, return_index=True)[1]))
            if held is not None:
                if keys[0].as_py() == last[0].as_py():
                    n[0] += held[0]
                else:
                    yield last, held
            if groups > 1:
                yield keys[:-1], n[:-1]
            last, held = keys[-1:], n[-1:].copy()
    if held is not None:
        yield last, held


def profile_batches(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for keys, n in _sums(batches):
        w = n / np.sqrt((n * n).sum(1, keepdims=True))
        columns = [(n > 0).sum(1), w.max(1), w @ np.arange(1.0, MOCK_DIM + 1)]
        yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns)], names=names)


def profile(rows: DataFrame, key: str) -> DataFrame:
    """Of each key's texts (column text) together: how many ``buckets`` their tokens
    fill, the largest weight of the unit vector (``top_weight``) and the sum of each
    weight times its bucket counted from 1 (``checksum``).  Rows of equal keys are
    one text, null is a key too; keys without tokens are left out."""
    kind = rows.schema[key].dataType.simpleString()
    counted = rows.select(key, F.col("text").cast("string")).mapInArrow(lambda b: count_batches(b, [key, "cells"]), f"`{key}` {kind}, cells binary")
    dealt = counted.repartition(F.col(key)).sortWithinPartitions(key)
    return dealt.mapInArrow(lambda b: profile_batches(b, [key, "buckets", "top_weight", "checksum"]), f"`{key}` {kind}, buckets long, top_weight double, checksum double")
