"""Keyword scores, ordinal ranks, rank fusion and structured boosts.

Every function takes candidates keyed by (request_id, query_id, pos), the lists
of many requests at once; nothing leaves the cluster until the last cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import WEIGHTS
from ..functions.text import normalised_terms, tokenize

RRF_K = 60
K1, B = 1.5, 0.75
BONUS = 0.08
HALF_LIFE_DAYS = 30.0
DAY_MS = 86400000.0
LIST = ["request_id", "query_id"]
TIE = 10  # decimals within which scores count as equal


def term_frequencies(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, tf of the texts of the candidates."""
    return candidates.select(*keys, F.explode(tokenize(F.col("text"))).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))


def document_frequencies(rows: DataFrame) -> DataFrame:
    """term, df: in how many rows each term occurs, in one shuffle."""
    return rows.select(F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Adds ``bm25``: the keyword score within each list's own pool.

    queries: request_id, query_id, query_text.  Document frequencies and the mean
    length are those of the pool, token-less candidates included.

    One pass: every candidate's tokens are exploded behind a mark that carries the
    candidate itself, and the join with the query's words (which hold the mark as
    well) keeps the mark and the matches."""
    mark = F.lit("\x00")
    words = queries.select(*LIST, F.explode(F.array_distinct(F.concat(tokenize(F.col("query_text")), F.array(mark)))).alias("term"))
    pool = Window.partitionBy(*LIST)
    tokens = candidates.withColumn("__tokens", tokenize(F.col("text")))
    tokens = tokens.withColumns({"__dl": F.size("__tokens").cast("double"), "__n": F.count("*").over(pool).cast("double")})
    mean = F.coalesce(F.nullif(F.sum("__dl").over(pool) / F.col("__n"), F.lit(0.0)), F.lit(1.0))
    tokens = tokens.withColumn("__mean", mean)
    own = [c for c in candidates.columns if c not in (*LIST, "pos")]
    flat = tokens.select(*LIST, "pos", "__dl", "__n", "__mean", *own, F.posexplode(F.concat(F.array(mark), F.col("__tokens"))).alias("__i", "term"))
    flat = flat.select(*LIST, "pos", "term", "__dl", "__n", "__mean", F.when(F.col("__i") == 0, F.struct(*own)).alias("__own"))
    tf = flat.join(words, [*LIST, "term"]).groupBy(*LIST, "pos", "term", "__dl", "__n", "__mean").agg(F.count("*").cast("double").alias("tf"), F.first("__own", ignorenulls=True).alias("__own"))
    df = F.count("*").over(Window.partitionBy(*LIST, "term")).cast("double")
    tf = tf.withColumn("__df", df)
    idf = F.log(1 + (F.col("__n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("__dl") / F.col("__mean")))
    score = F.sum(F.when(F.col("term") != mark, part).otherwise(0.0)).alias("bm25")
    scored = tf.groupBy(*LIST, "pos").agg(score, F.first("__own", ignorenulls=True).alias("__own"))
    return scored.select(*LIST, "pos", "__own.*", "bm25")


def ordinal(score: str | Column) -> Column:
    """0-based rank in a list, best first, ties by position."""
    score = F.col(score) if isinstance(score, str) else score
    return F.row_number().over(Window.partitionBy(*LIST).orderBy(F.desc(F.round(score, TIE)), "pos")) - 1


def rrf(candidates: DataFrame, weights: dict = WEIGHTS, k: int = RRF_K) -> DataFrame:
    """Adds dense_rank, bm25_rank, both and rrf from ``dense`` and ``bm25``."""
    ranked = candidates.withColumns({"dense_rank": ordinal("dense"), "bm25_rank": ordinal("bm25")})
    half = F.count("*").over(Window.partitionBy(*LIST)) / 2
    ranked = ranked.withColumn("both", (F.col("dense_rank") < half) & (F.col("bm25_rank") < half) & (F.col("bm25") > 0))
    fused = F.lit(float(weights["cosine"])) / (k + F.col("dense_rank") + 1) + F.lit(float(weights["bm25"])) / (k + F.col("bm25_rank") + 1)
    return ranked.withColumn("rrf", fused * F.when(F.col("both"), 1 + BONUS).otherwise(1.0))


def importance_term(importance: Column, weight: float) -> Column:
    ok = importance.isNotNull() & ~F.isnan(importance) & (F.abs(importance) != float("inf"))
    return F.when(ok, weight * F.least(F.lit(10.0), F.greatest(F.lit(0.0), importance)) / 10).otherwise(0.0)


def recency_term(ts_ms: Column, now_ms: float, weight: float, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(float(now_ms)) - ts_ms) / DAY_MS)
    ok = ts_ms.isNotNull() & ~F.isnan(ts_ms) & (ts_ms > 0) & (ts_ms != float("inf"))
    return F.when(ok, weight * F.pow(F.lit(0.5), age / half_life_days)).otherwise(0.0)


def entity_term(entities: Column, wanted: Column, weight: float) -> Column:
    return F.when(F.arrays_overlap(normalised_terms(entities), normalised_terms(wanted)), F.lit(float(weight))).otherwise(0.0)


def fuse(contributions: DataFrame) -> DataFrame:
    """Lists of a request merged by (collection, id): summed rrf, best bm25 and
    dense, and the candidate as the first list has it."""
    first = F.struct("query_id", "pos", *[c for c in contributions.columns if c not in ("query_id", "pos", "request_id", "collection", "id", "rrf")])
    merged = contributions.groupBy("request_id", "collection", "id").agg(
        F.sum("rrf").alias("rrf"), F.max("bm25").alias("bm25_best"), F.max("dense").alias("dense_best"), F.min_by(first, F.struct("query_id", "pos")).alias("own")
    )
    return merged.select("request_id", "collection", "id", "rrf", "bm25_best", "dense_best", "own.*")


def boosted(merged: DataFrame, requests: DataFrame, now_ms: float, weights: dict = WEIGHTS, half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """Adds final_score: fusion plus importance, recency and entity terms, once.

    requests: request_id, entities as ``wanted``."""
    joined = merged.join(requests.select("request_id", "wanted"), "request_id", "left")
    wanted = F.coalesce("wanted", F.array().cast("array<string>"))
    terms = importance_term(F.col("importance"), weights["importance"]) + recency_term(F.col("ts_ms"), now_ms, weights["recency"], half_life_days) + entity_term(F.col("entities"), wanted, weights["entity"])
    return joined.withColumn("final_score", F.col("rrf") + terms).drop("wanted")


def cut(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The best k of each request, ties by first list and position."""
    window = Window.partitionBy("request_id").orderBy(F.desc(F.round(score, TIE)), "query_id", "pos")
    return scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def best_dense(candidates: DataFrame, k: int) -> DataFrame:
    """Dense search over several lists: each row once with its best score."""
    own = Window.partitionBy("request_id", "collection", "id").orderBy(F.desc(F.round("dense", TIE)), "query_id", "pos")
    once = candidates.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")
    return cut(once, "dense", k)
