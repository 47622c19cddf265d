"""Packed arrays as table rows: a task deals its arrays over hash buckets, one
compressed row for each bucket, so an exchange moves few, large rows."""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K

ROW = "bucket int, kind int, payload binary"
NAMES = ["bucket", "kind", "payload"]


def pack(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(x, protocol=5))


def unpack(raw: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(raw))


def rows(packed: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """(bucket, kind, payload) rows as an Arrow batch."""
    columns = list(zip(*packed)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()))], names=NAMES)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (K.mix(keys.view(np.uint64) + np.uint64(7)) % np.uint64(buckets)).astype(np.int64)


def dealt(keys: np.ndarray, buckets: int):
    """(bucket, indices) of every bucket that has any of the keys."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)):
        yield int(b), order[cut[b] : cut[b + 1]]


@lru_cache(maxsize=64)
def _labels(spark, partitions: int) -> tuple[int, ...]:
    """For each partition a number that Spark's hash partitioning sends there."""
    ids = spark.range(32 * partitions).select(F.col("id").cast("int").alias("label"))
    found = ids.groupBy(F.pmod(F.hash("label"), F.lit(partitions)).alias("at")).agg(F.min("label").alias("label")).collect()
    at = {r["at"]: r["label"] for r in found}
    return tuple(at.get(p, p) for p in range(partitions))


def by_bucket(df: DataFrame, partitions: int) -> DataFrame:
    """Bucket b to partition b modulo ``partitions``, the same number of buckets
    to each; beyond 4096 partitions hashing is even enough."""
    if partitions > 4096:
        return df.repartition(partitions, "bucket")
    labels = F.array(*[F.lit(x) for x in _labels(df.sparkSession, partitions)])
    return df.repartition(partitions, F.element_at(labels, F.pmod("bucket", F.lit(partitions)) + 1))
