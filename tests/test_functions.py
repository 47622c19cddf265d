"""Scalar expressions against independent Python models."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import params as P
from tessera.functions import text as X
from tessera.functions import vector as V


def model_hash(text: str) -> int:
    h = 2166136261
    raw = text.encode("utf-16-le", "surrogatepass")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) % 2**32
    return h


TEXTS = ["", "a", "Grüße", "naïve café", "𝔘nicode 😀 pair", "line\nbreak\t tab", "x" * 500]


def test_hash_expression_and_bulk_form_agree_with_the_definition(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", X.fnv1a(F.col("t")).alias("a"), X.content_hash("t").alias("b"), X.units_length(F.col("t")).alias("n"))
    for r in df.collect():
        assert r.a == r.b == model_hash(r.t)
        assert r.n == len(r.t.encode("utf-16-le")) // 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=8))
def test_bulk_hash_property(texts):
    assert X.fnv1a_many(texts).tolist() == [model_hash(t) for t in texts]


def test_bulk_hash_in_groups_gives_the_same(monkeypatch):
    texts = ["ab" * 40, "", "𝔘nicode", "x", "y" * 7, "é" * 30]
    whole = X.fnv1a_many(texts).tolist()
    monkeypatch.setattr(X, "HASH_CHARS", 10)
    assert X.fnv1a_many(texts).tolist() == whole == [model_hash(t) for t in texts]
    assert X.fnv1a_many([]).tolist() == []


def test_null_text_hashes_as_empty(spark):
    row = spark.sql("select cast(null as string) t").select(X.fnv1a(F.col("t")), X.content_hash("t")).first()
    assert tuple(row) == (2166136261, 2166136261)


def test_uint32(spark):
    df = spark.createDataFrame([(-1,), (2**32 + 5,)], "x long")
    assert [r[0] for r in df.select(X.uint32(F.col("x"))).collect()] == [2**32 - 1, 5]


def test_trim_strips_every_unicode_blank(spark):
    df = spark.createDataFrame([(" ﻿\t mid dle   \n",)], "t string")
    assert df.select(X.js_trim(F.col("t"))).first()[0] == "mid dle"


def test_tokenize_drops_stopwords_and_single_units(spark):
    df = spark.createDataFrame([("The Owl-Bear's 2 cubs, élan vital 42!",)], "t string")
    assert df.select(X.tokenize(F.col("t"))).first()[0] == ["owl", "bear", "cubs", "élan", "vital", "42"]


def test_mock_embedding_expression_is_a_unit_vector(spark):
    v = spark.createDataFrame([("red red blue",), ("??",)], "t string").select(X.mock_embed(F.col("t")).alias("v")).collect()
    assert math.isclose(sum(x * x for x in v[0].v), 1.0) and len(v[0].v) == 256
    assert sum(v[1].v) == 0


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    out = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.l2_normalise(F.col("a")).alias("u"), V.finite(F.col("a")).alias("ok")).collect()
    assert math.isclose(out[0].c, 0.96) and out[1].c is None
    assert out[0].u == [pytest.approx(0.6), pytest.approx(0.8)] and out[1].u == [0.0, 0.0]
    bad = spark.createDataFrame([([float("nan")],), ([float("inf")],), ([1.0],)], "a array<double>")
    assert [r[0] for r in bad.select(V.finite(F.col("a"))).collect()] == [False, False, True]


@pytest.mark.parametrize("value, want", [(None, 1), ("7.9", 7), (-3, 1), (900, 100), ("x", 5), (float("nan"), 5), ("", 1)])
def test_clamp_int(value, want):
    assert P.clamp_int(value, 5, 1, 100) == want


def test_clamps_use_the_fallback_when_absent():
    assert P.clamp_int(fallback=5, low=1, high=100) == 5 and P.clamp_float(fallback=0.25) == 0.25


def test_request_rules():
    r = P.request(search_texts=[" a ", "", None, *"bcdefghij"], collections=["docs", "docs"], entities=[" X ", ""], top_k=20, threshold=0.9, weights={"bm25": 2})
    assert r.texts == list("abcdefgh") and r.collections == ["docs", "docs"] and r.entities == ["X"]
    assert r.candidates == 100 and r.floor == 0.0 and r.weights["bm25"] == 2 and r.weights["cosine"] == 1.0
    dense = P.request(search_text="q", collection="docs", hybrid=False, threshold=0.4)
    assert dense.candidates == 5 and dense.floor == 0.4
    assert P.request(search_text="q", collection="docs", hybrid=None).hybrid
    for bad in ({"search_text": " ", "collection": "docs"}, {"search_text": "q", "collection": "lore"}, {"search_text": "q", "collection": "../docs"}):
        with pytest.raises(P.RequestError) as e:
            P.request(**bad)
        assert e.value.status == 400
    assert len(P.COLLECTIONS) == 35
