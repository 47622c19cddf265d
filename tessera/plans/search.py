"""Dense and hybrid search composed from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.params import WEIGHTS, candidate_k
from ..functions.vector import clamped
from ..operators import knn, rank
from ..sources.scratch import settle

#: Payload rows (collection, id and further columns) of the ids that are given.
Payload = Callable[[DataFrame], DataFrame]


def candidates(rows: DataFrame | Payload, queries: DataFrame, k: int, threshold: float = 0.0, vectors: DataFrame | None = None, raw: bool = False) -> DataFrame:
    """Candidate lists: the best k rows of each query and collection, score at
    least the threshold.  The score is the cosine clamped to 0..1, or as it is with
    ``raw``.

    rows: id, collection, vector and payload columns; queries: request_id,
    query_id, query_text, vector, collections (in list order; one that is named
    twice counts twice).  Only ids and similarities pass the top-k; payloads are
    joined to what is left.  Where the payload is a join of tables, ``vectors`` gives
    id, collection and vector, and ``rows`` is a function from a table of ids to
    their payload, so that each table is cut down to the candidates before it is
    joined."""
    best = knn.top_k_of_all(rows if vectors is None else vectors, queries, k)
    asked = queries.select("request_id", "query_id", F.posexplode("collections").alias("place", "collection"))
    found = best.join(asked, ["query_id", "collection"]).withColumn("dense", F.col("cosine") if raw else clamped(F.col("cosine"))).where(F.col("dense") >= threshold)
    pos = F.row_number().over(Window.partitionBy("request_id", "query_id").orderBy("place", "rank")) - 1
    found = found.withColumn("pos", pos).select("request_id", "query_id", "pos", "collection", "id", "dense")
    if callable(rows):
        found = settle(found, "candidates")
        rows = rows(found.select("id").distinct())
    return found.join(rows.drop("vector"), ["collection", "id"])


def hybrid(rows: DataFrame | Payload, queries: DataFrame, top_k: int, now_ms: float, requests: DataFrame | None = None, weights: dict = WEIGHTS, half_life_days: float = rank.HALF_LIFE_DAYS, vectors: DataFrame | None = None, rrf_k: int = rank.RRF_K) -> DataFrame:
    """Dense and keyword ranks fused over a request's sub-queries, boosted once,
    best top_k of each request.  requests: request_id, wanted (entities)."""
    lists = candidates(rows, queries, candidate_k(top_k), vectors=vectors)
    scored = rank.rrf(rank.bm25(lists, queries), weights, rrf_k)
    requests = requests if requests is not None else queries.select("request_id").distinct().withColumn("wanted", F.array().cast("array<string>"))
    return rank.cut(rank.boosted(rank.fuse(scored), requests, now_ms, weights, half_life_days), "final_score", top_k)


def dense(rows: DataFrame | Payload, queries: DataFrame, top_k: int, threshold: float = 0.0, vectors: DataFrame | None = None, raw: bool = False) -> DataFrame:
    """Best rows by similarity alone, a floor on the score, each row once."""
    return rank.best_dense(candidates(rows, queries, top_k, threshold, vectors, raw), top_k)
