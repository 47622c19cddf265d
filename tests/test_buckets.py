"""Bucket counts against the expression of the offline embedding and a plain model."""

import math
import re
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions import batches
from tessera.operators import buckets

ODD = ["Red red blue-BLUE 42", "", None, "??", "\u212aelvin 27\u2103 A\u212a", "\u0130stanbul x\u0130y", "𝔘nicode cafés", "a", "Z" * 63 + " " + "Z" * 64 + " " + "Z" * 65, "q7" * 3000, "end", "start", "ßΣ Ångström"]


def model(text):
    return Counter(int(h) % X.MOCK_DIM for h in X.fnv1a_many(re.findall("[a-z0-9]+", (text or "").lower())))


def counted(texts):
    where, bucket = buckets.token_buckets(pa.array(texts, pa.string()))
    own = [Counter() for _ in texts]
    for i, b in zip(where.tolist(), bucket.tolist()):
        own[i][b] += 1
    return own


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=30), st.text("aZ9 .é", max_size=90)), max_size=8))
def test_token_buckets_follow_the_hash(texts):
    assert counted(texts) == [model(t) for t in texts]


def test_odd_texts_and_slices():
    assert counted(ODD) == [model(t) for t in ODD]
    where, bucket = buckets.token_buckets(pa.array(["zz", *ODD], pa.string())[5:7])
    assert Counter(bucket.tolist()) == model(ODD[4]) + model(ODD[5])


def test_profile_matches_the_expression(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(0, "and more"), (None, "null id"), (None, "again null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in buckets.profile(docs, "doc_id").collect()}
    tokens = docs.select("doc_id", F.explode(X.mock_tokens(F.col("text"))).alias("t")).groupBy("doc_id", X.mock_bucket(F.col("t")).alias("b")).count().collect()
    want = {}
    for r in tokens:
        want.setdefault(r.doc_id, {})[r.b] = r["count"]
    assert got.keys() == want.keys() and None in got and 1 not in got
    for key, n in want.items():
        size = math.sqrt(sum(x * x for x in n.values()))
        assert got[key] == (len(n), pytest.approx(max(n.values()) / size), pytest.approx(sum(x / size * (b + 1) for b, x in n.items())))
    assert buckets.profile(docs.limit(0), "doc_id").count() == 0


def test_sums_of_a_key_cross_pieces_and_batches(monkeypatch):
    monkeypatch.setattr(batches, "PIECE_ROWS", 2)
    monkeypatch.setattr(buckets, "PIECE_ROWS", 2)
    keys, texts = [1, 1, 1, 2, 3, 3, None, None, None], ["a", "b a", "", "c", "d", "e", "f", "g", "f"]
    batch = pa.RecordBatch.from_pydict({"k": pa.array(keys), "text": texts})
    parts = list(buckets.count_batches([batch, batch.slice(0, 0)], ["k", "c"]))
    assert sum(p.num_rows for p in parts) <= len(keys)
    got = [(k, round(n.sum())) for ks, ns in buckets._sums(parts) for k, n in zip(ks.to_pylist(), ns)]
    assert got == [(1, 3), (2, 1), (3, 2), (None, 3)]


def test_plan_carries_no_row_for_each_word(spark):
    from tessera.plans import catalog

    plan = catalog.mock_embed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
