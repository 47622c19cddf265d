"""Keyword scores, fusion and boosts on small fixtures and against a plain model."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.params import WEIGHTS, RequestError
from tessera.operators import knn, rank

CANDIDATES = "request_id int, query_id int, pos int, collection string, id long, text string, dense double, importance double, ts_ms double, entities array<string>"
QUERIES = "request_id int, query_id int, query_text string"
REQUESTS = "request_id int, wanted array<string>"
DAY = 86400000.0


def fused(spark, rows, queries, wanted=(), now=400 * DAY):
    c = spark.createDataFrame(rows, CANDIDATES)
    q = spark.createDataFrame(queries, QUERIES)
    r = spark.createDataFrame([(0, list(wanted))], REQUESTS)
    out = rank.boosted(rank.fuse(rank.rrf(rank.bm25(c, q))), r, now)
    return rank.cut(out, "final_score", 10).orderBy("rank").collect()


def test_bm25_matches_the_formula(spark):
    texts = ["red dragon red", "blue dragon", "", "green field of grass"]
    c = spark.createDataFrame([(0, 0, i, "c", i, t, 0.0, None, None, None) for i, t in enumerate(texts)], CANDIDATES)
    q = spark.createDataFrame([(0, 0, "red dragon red dragon owl")], QUERIES.replace("query_id int", "query_id int"))
    got = {r.pos: r.bm25 for r in rank.bm25(c, q).collect()}
    docs = [["red", "dragon", "red"], ["blue", "dragon"], [], ["green", "field", "grass"]]
    mean = sum(map(len, docs)) / 4
    for i, d in enumerate(docs):
        want = 0.0
        for t in ("red", "dragon", "owl"):
            n, f = sum(t in x for x in docs), d.count(t)
            want += math.log(1 + (4 - n + 0.5) / (n + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(d) / mean)) if f else 0
        assert got[i] == pytest.approx(want)


def test_keyword_match_rises(spark):
    texts = ["meadow", "river stones", "castle wall", "the amber sigil glows", "ship"]
    rows = [(0, 0, i, "c", i, t, 0.9 - i / 100, None, None, None) for i, t in enumerate(texts)]
    got = fused(spark, rows, [(0, 0, "amber sigil")])
    assert got[0].id in (0, 3) and [r.id for r in got].index(3) <= 1
    assert got[[r.id for r in got].index(3)].bm25_best > 0


@pytest.mark.parametrize("a, b", [((2.0, None, None), (9.0, None, None)), ((None, 280 * DAY, None), (None, 399 * DAY, None)), ((None, None, ["ogre"]), (None, None, [" LYRA "]))])
def test_structured_terms_break_ties(spark, a, b):
    rows = [(0, 0, i, "c", i, "same text here", 0.5, *x) for i, x in enumerate((a, b))]
    assert fused(spark, rows, [(0, 0, "other words")], ["lyra"])[0].id == 1


def test_lists_fuse_once_per_row(spark):
    rows = [(0, 0, 0, "c", 1, "alpha", 0.9, None, None, None), (0, 0, 1, "c", 2, "beta", 0.8, None, None, None), (0, 1, 0, "c", 3, "gamma", 0.7, None, None, None), (0, 1, 1, "c", 1, "alpha", 0.6, None, None, None)]
    got = fused(spark, rows, [(0, 0, "x"), (0, 1, "y")])
    assert [r.id for r in got][0] == 1 and len(got) == 3
    assert got[0].dense_best == 0.9 and got[0].query_id == 0
    assert got[0].rrf == pytest.approx((1 / 61 + 1 / 61) + (1 / 62 + 1 / 62))


def test_bonus_needs_both_upper_halves_and_a_keyword_match(spark):
    rows = [(0, 0, i, "c", i, t, 0.9 - i / 10, None, None, None) for i, t in enumerate(["owl nest", "owl", "x y", "z w"])]
    c = spark.createDataFrame(rows, CANDIDATES)
    got = {r.id: r for r in rank.rrf(rank.bm25(c, spark.createDataFrame([(0, 0, "owl")], QUERIES))).collect()}
    assert got[0].both and got[1].both and not got[2].both and not got[3].both


def test_terms_clamp_and_ignore_bad_values(spark):
    df = spark.createDataFrame([(50.0, -5.0), (None, None), (float("nan"), 1e18), (-3.0, 400 * DAY)], "i double, t double")
    out = df.select(rank.importance_term(F.col("i"), 0.25).alias("i"), rank.recency_term(F.col("t"), 400 * DAY, 0.15).alias("t")).collect()
    assert [r.i for r in out] == [0.25, 0.0, 0.0, 0.0]
    assert [r.t for r in out] == [0.0, 0.0, pytest.approx(0.15), pytest.approx(0.15)]


def test_top_k_ties_zero_vectors_and_dimensions(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], v) for i, v in enumerate([[1.0, 0.0], [2.0, 0.0], [0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [float("nan"), 1.0]])], "id long, collection string, vector array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id int, vector array<float>")
    got = {(r.collection, r["rank"]): (r.id, round(r.cosine, 6)) for r in knn.top_k(rows, q, 2).collect()}
    assert got == {("a", 1): (0, 1.0), ("a", 2): (4, 0.707107), ("b", 1): (1, 1.0), ("b", 2): (3, 0.0)}
    assert knn.top_k(rows, q, 0).where("rank > 1").count() == 0  # a bad k counts as 1
    assert knn.top_k(rows, q.limit(0), 2).count() == 0
    bad = spark.createDataFrame([(1, "a", [1.0])], "id long, collection string, vector array<float>")
    with pytest.raises(Exception, match="dimension"):
        knn.top_k(bad, q, 2).collect()
    with pytest.raises(RequestError):
        knn.top_k(rows, spark.range(5000).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector")), 2)


def test_top_k_of_all_deals_queries_into_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "ab"[i % 2], [float(i % 7) - 3, float(i % 5) - 2]) for i in range(40)], "id long, collection string, vector array<float>")
    queries = rows.where("id % 2 = 0 and id not in (10, 24)").select(F.col("id").alias("query_id"), "vector")
    whole = sorted(map(tuple, knn.top_k(rows, queries, 3).collect()))
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 4)
    with pytest.raises(RequestError):
        knn.top_k(rows, queries, 3)
    got = knn.top_k_of_all(rows, queries, 3)
    assert whole and sorted(map(tuple, got.collect())) == whole
    assert knn.top_k_of_all(rows, queries.limit(0), 3).count() == 0


def test_similarities_of_a_batch_are_held_in_parts(monkeypatch):
    draw = np.random.default_rng(5)
    rows, queries = draw.integers(-3, 4, (6000, 8)).astype(float), draw.integers(-3, 4, (1500, 8)).astype(float)
    rows[17], queries[3] = 0, 0
    names = pa.array([None if i % 5 == 0 else "ab"[i % 2] for i in range(len(rows))], pa.string())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(rows))), names, pa.array(list(rows))], names=["id", "collection", "vector"])
    ids = pa.array(range(100, 100 + len(queries)))

    def found():
        tracemalloc.start()
        parts = list(knn.best_batches([batch, batch.slice(0, 0)], knn._unit(queries), ids, 3))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return peak, len(parts), sorted((r["query_id"], str(r["collection"]), r["id"], r["cosine"]) for p in parts for r in p.to_pylist())

    peak, parts, got = found()
    assert peak < len(rows) * len(queries) * 8 / 2 and parts > 1  # less than half of all similarities
    assert {r[0] for r in got} == {*range(100, 1600)} - {103} and all(r[2] != 17 for r in got)
    monkeypatch.setattr(knn, "CELLS", 1 << 40)
    peak, parts, whole = found()
    assert peak > len(rows) * len(queries) * 8 and parts == 1 and got == whole


def test_memory_of_a_search_does_not_grow_with_its_queries():
    draw = np.random.default_rng(6)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(["a", "b"] * 2000), pa.array(list(draw.normal(size=(4000, 4))))], names=["id", "collection", "vector"])
    peaks = []
    for n in (500, 2000):
        tracemalloc.start()
        assert sum(p.num_rows for p in knn.best_batches([batch], knn._unit(draw.normal(size=(n, 4))), pa.array(range(n)), 2)) == 4 * n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]


@pytest.mark.parametrize("name", ["cosine_topk", "cosine_topk_per_collection", "hybrid_multi_query", "dense_threshold"])
def test_queries_beyond_one_block_give_the_same_rows(spark, monkeypatch, name):
    from tessera.plans import catalog

    sf = "/root/testdata/sf0.001"
    want = sorted(map(str, catalog.QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 3)
    assert sorted(map(str, catalog.QUERIES[name](spark, sf).collect())) == want
