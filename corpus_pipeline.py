"""A corpus pipeline of five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of ``documents``; the last returns packed pieces.

Cases, in every stage: a null text is an empty one, further columns pass through
whatever their names, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontam, exact_dedup, jaccard, packing, toxicity
from tessera.llm.queries import packed, toxicity_model
from tessera.sources.scratch import settle
from tessera.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject.  Rows are judged by their
    own text, so repeated rows and rows with a null id share their text's fate; an
    empty text stays unless the labels make the background toxic."""
    return toxicity.reject(docs, toxicity_model(spark, sf_dir))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: the smallest id, a null id counting as
    larger than any other; of rows that repeat id and text one stays.  Null and
    empty texts are one group."""
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of near copies.  A text without words and
    a row with a null id stay; rows that repeat an id stay or go together."""
    return jaccard.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs: 8 words in a row, or
    the whole of a shorter item.  One item is enough to go, since one leaked item
    spoils the benchmark; a text without words stays."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), min_items=1)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; an empty text is a piece of one token."""
    return packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_benchmark),
    ("packing", pack),
]

#: Learned scores and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, from the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
