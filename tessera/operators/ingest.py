"""Which chunks are new: stored rows and repeats are left out before the costly
embedding step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_of_hash(items: DataFrame, order: list[str]) -> DataFrame:
    """The first item of each hash in the given order."""
    rank = F.row_number().over(Window.partitionBy("hash").orderBy(*order))
    return items.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def fresh(items: DataFrame, stored: DataFrame, order: list[str]) -> DataFrame:
    """Items whose hash is neither stored nor an earlier item's."""
    return first_of_hash(items.join(stored.select("hash").distinct(), "hash", "left_anti"), order)


def counters(items: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: inserted, chunks, skipped, already_stored, repeats.

    A stored chunk counts as stored however often it comes; only the others can
    be repeats.  Items are combined by hash before the join."""
    by_hash = items.groupBy("hash").agg(F.count("*").alias("n"))
    known = stored.select("hash").distinct().withColumn("known", F.lit(True))
    joined = by_hash.join(known, "hash", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    is_known = F.col("known").isNotNull()
    out = joined.agg(
        total(F.when(~is_known, 1)).alias("inserted"),
        total(F.col("n")).alias("chunks"),
        total(F.when(is_known, F.col("n"))).alias("already_stored"),
        total(F.when(~is_known, F.col("n") - 1)).alias("repeats"),
    )
    return out.withColumn("skipped", F.col("already_stored") + F.col("repeats"))


def upsert(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows replace existing ones of the same hash."""
    return existing.join(rows.select("hash").distinct(), "hash", "left_anti").unionByName(rows)


def remove(existing: DataFrame, keys: DataFrame) -> DataFrame:
    """Existing rows without those whose id is among the keys (ids and hashes as
    strings, doubles allowed)."""
    return existing.join(keys.select(F.col("key").alias("id")).distinct(), "id", "left_anti")
