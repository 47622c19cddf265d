"""Text expressions.

Lengths and offsets of chunks and the content hash count UTF-16 code units, as
the stored data does; a character outside the basic plane is two units.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .batches import cuts

# The words that keyword search leaves out.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to "
    "was will with from your you i we our"
).split()

# The parameters of 32-bit FNV-1a.
FNV_SEED, FNV_PRIME, UINT32 = 2166136261, 16777619, 0xFFFFFFFF
MOCK_DIM = 256


def js_trim(text: Column) -> Column:
    """Strip Unicode white space, line ends, no-break blanks and byte-order marks."""
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def code_units(text: Column) -> Column:
    """The UTF-16 code units of a string as an array of longs."""

    def units(c: Column) -> Column:
        point = F.ascii(c).cast("long")
        high = F.lit(0xD800) + F.shiftright(point - 0x10000, 10)
        low = F.lit(0xDC00) + (point - 0x10000).bitwiseAND(F.lit(1023))
        return F.when(point > 0xFFFF, F.array(high, low)).otherwise(F.array(point))

    # split() leaves an empty string for an empty text
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    plain = F.transform(chars, lambda c: F.ascii(c).cast("long"))
    wide = F.flatten(F.transform(chars, units))
    return F.when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), wide).otherwise(plain)


def units_length(text: Column) -> Column:
    """Length of a string in UTF-16 code units."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as a long; null is the empty text."""
    step = lambda h, u: ((h.bitwiseXOR(u)) * F.lit(FNV_PRIME).cast("long")).bitwiseAND(F.lit(UINT32).cast("long"))
    return F.aggregate(code_units(F.coalesce(text, F.lit(""))), F.lit(FNV_SEED).cast("long"), step)


def uint32(number: Column) -> Column:
    """A number as an unsigned 32-bit id."""
    return number.cast("long").bitwiseAND(F.lit(UINT32).cast("long"))


# Characters that are hashed together: bounds the code units held at once.
HASH_CHARS = 4 << 20


def fnv1a_many(texts: list[str]) -> np.ndarray:
    """The same hash of many texts, longest first, in groups of bounded size."""
    size = np.array([len(t) for t in texts], np.int64)
    by = np.argsort(-size, kind="stable")
    out = np.empty(len(texts), np.int64)
    for begin, end in cuts(size[by], HASH_CHARS):
        out[by[begin:end]] = _fnv1a_group([texts[i] for i in by[begin:end].tolist()])
    return out


def _fnv1a_group(texts: list[str]) -> np.ndarray:
    """All advance one code unit at a time, longest first, so each step is one array
    operation."""
    raw = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    size = np.array([len(r) // 2 for r in raw], np.int64)
    units = np.frombuffer(b"".join(raw), np.uint16)
    first = np.cumsum(size) - size
    by = np.argsort(-size, kind="stable")
    first, size = first[by], size[by]
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
    h = np.full(len(raw), FNV_SEED, np.uint64)
    prime, low = np.uint64(FNV_PRIME), np.uint64(UINT32)
    for t, n in enumerate(live.tolist()):
        h[:n] = ((h[:n] ^ units[first[:n] + t]) * prime) & low
    out = np.empty(len(raw), np.int64)
    out[by] = h.astype(np.int64)
    return out


@F.pandas_udf(LongType())
def content_hash(text: pd.Series) -> pd.Series:
    """FNV-1a of a column of texts, in Arrow batches: the bulk form of :func:`fnv1a`."""
    return pd.Series(fnv1a_many([t or "" for t in text]))


def tokenize(text: Column) -> Column:
    """Keyword tokens: lower-case runs of letters and digits, longer than one
    unit, without stopwords.  A single character has two units if it lies outside
    the basic plane, which takes four bytes."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.filter(found, lambda t: ((F.length(t) > 1) | (F.octet_length(t) > 3)) & ~t.isin(STOPWORDS))


def mock_tokens(text: Column) -> Column:
    """Tokens of the offline embedding."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), 0)


def mock_bucket(token: Column) -> Column:
    """Dimension that a token adds to."""
    return (fnv1a(token) % MOCK_DIM).cast("int")


def mock_embed(text: Column) -> Column:
    """Dense offline embedding: token counts by hash bucket, scaled to length 1."""
    buckets = F.transform(mock_tokens(text), mock_bucket)
    counts = F.transform(F.sequence(F.lit(0), F.lit(MOCK_DIM - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: x / F.coalesce(F.nullif(norm, F.lit(0.0)), F.lit(1.0)))


def normalised_terms(values: Column) -> Column:
    """Entities as they are compared: lower case, trimmed, blanks left out."""
    return F.filter(F.transform(values, lambda v: js_trim(F.lower(F.coalesce(v, F.lit(""))))), lambda v: v != "")
