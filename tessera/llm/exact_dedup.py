"""Exact deduplication by skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical after each run of ASCII white space is
replaced by one blank.  Three combining stages, each of which groups by the
whole normalised text beside its digest, so a digest alone never decides:

1. local: every input partition combines its own rows (the map side of the
   first aggregation);
2. salted: rows of a digest meet under (digest, salt), where the salt is the
   input partition's, so a text that fills a third of all rows is dealt over
   many tasks;
3. global: the salt winners of a digest, at most ``SALTS`` rows for each text,
   are combined.

Stage 3 also counts the different texts of each digest.  A digest with one text
(proved by stage 3) then stands for it, and documents find their group by the
digest alone; for digests with several texts the whole text is joined.
The membership join has two plain shuffles, so adaptive execution splits a hot
digest's partition.

Cases: a null text is an empty text.  A null id is larger than any other.  An
empty table gives an empty result.  Rows that repeat an id and a text count as
members each, all of them carry ``kept`` in :func:`classify`, and
:func:`deduplicate` returns one of them.  Further columns of the input are left
alone whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import settle

SALTS = 64


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one blank; null becomes empty.

    Only runs that are not a single blank already are matched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    norm = normalised(docs[text_col].cast("string"))
    return docs.select(*extra, docs[id_col].alias("__id"), norm.alias("__norm")).withColumn(
        "__digest", F.unhex(F.sha2("__norm", 256))
    )


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each different text: __digest, __norm, keep_id, group_size."""
    rows = _keyed(docs, id_col, text_col).withColumn("__salt", F.spark_partition_id() % SALTS)
    salted = rows.groupBy("__digest", "__salt", "__norm").agg(F.min("__id").alias("keep"), F.count("*").alias("size"))
    return (
        salted.repartition("__digest")
        .groupBy("__digest", "__norm")
        .agg(F.min("keep").alias("keep_id"), F.sum("size").alias("group_size"))
    )


def _winners(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Groups of the digests that stand for one text, and the other digests."""
    whole = groups(docs, id_col, text_col)
    counted = whole.groupBy("__digest").agg(
        F.count("*").alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    settled = settle(counted, "exact-groups")
    single = settled.where("texts = 1").select("__digest", "keep_id", "group_size")
    several = settled.where("texts > 1").select("__digest")
    return single, several


def _members(docs: DataFrame, id_col: str, text_col: str, *extra: Column) -> DataFrame:
    single, several = _winners(docs, id_col, text_col)
    rows = _keyed(docs, id_col, text_col, *extra)
    found = rows.join(single, "__digest")
    if not several.isEmpty():  # different texts under one digest: join on the whole text
        clashing = groups(docs, id_col, text_col).join(several, "__digest", "left_semi")
        found = found.unionByName(rows.join(clashing, ["__digest", "__norm"]))
    same = F.col("__id").eqNullSafe(F.col("keep_id"))
    return found.withColumn("__kept", same)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, keep_id, group_size, kept, text_sha256."""
    found = _members(docs, id_col, text_col)
    return found.select(
        F.col("__id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        F.col("__kept").alias("kept"),
        F.lower(F.hex("__digest")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one for each different text, columns unchanged."""
    found = _members(docs, id_col, text_col, F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    kept = found.where("__kept").dropDuplicates(["__digest", "__id", "__norm"])
    return kept.select("__row.*")
