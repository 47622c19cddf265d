"""Store round trips: ingest, overwrite, delete, purge, search, streaming."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tessera.functions import params as P
from tessera.operators import embed as E
from tessera.operators import ingest
from tessera.plans import search
from tessera.sources import config, files
from tessera.sources.store import Store, open_store
from tessera.streaming.ingest import ingest_stream

FACTS = ["The lighthouse keeper hides a brass compass under the stairs.", "Wolves gather near the frozen mill whenever the bells ring.", "Tax on imported silk doubled after the harvest festival."]


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/memory", allowed=("docs", "lore"))


def docs(spark, texts, **meta):
    return files.documents(spark, [{"text": t, "metadata": meta} for t in texts])


def counts(row):
    r = row.first()
    return r.inserted, r.chunks, r.already_stored, r.repeats, r.skipped


def test_ingest_is_idempotent_and_counts(spark, store):
    assert counts(store.ingest(docs(spark, [FACTS[0], FACTS[1], FACTS[0], FACTS[0]]), "docs")) == (2, 4, 0, 2, 2)
    assert counts(store.ingest(docs(spark, FACTS), "docs")) == (1, 3, 2, 0, 2)
    assert counts(store.ingest(docs(spark, [FACTS[0], FACTS[0]]), "docs")) == (0, 2, 2, 0, 2)
    assert store.list_hashes("docs").count() == 3
    assert [(r.collection, r["count"]) for r in store.stats().collect()] == [("docs", 3)]


def test_search_finds_the_fact_and_unites_topics(spark, store):
    store.ingest(docs(spark, FACTS), "lore")
    one = store.query(P.request("who hides a compass under the stairs", collection="lore", top_k=1, allowed=store.allowed), 0).collect()
    assert one[0].text == FACTS[0] and one[0].metadata["kind"] == "prose"
    two = store.query(P.request(search_texts=["frozen mill wolves", "tax on silk"], collections=["lore"], top_k=2, allowed=store.allowed), 0).collect()
    assert {r.text for r in two} == set(FACTS[1:])
    dense = store.query(P.request("frozen mill wolves bells", collection="lore", hybrid=False, threshold=0.3, allowed=store.allowed), 0).collect()
    assert [r.text for r in dense] == [FACTS[1]]
    assert store.query(P.Request(["x"], []), 0).count() == 0


def test_answer_has_the_shape_of_a_request(spark, store):
    store.ingest(docs(spark, FACTS), "lore")
    found = store.answer(P.request(search_texts=["frozen mill", "silk"], collections=["lore"], top_k=2, allowed=store.allowed), 0)
    assert (found["mode"], found["subqueries"], len(found["hits"])) == ("hybrid", 2, 2)

    class Elsewhere(E.MockEmbedder):
        def batch(self, texts):
            return super().batch([FACTS[2]] * len(texts))

    asked = P.request("wolves", collection="lore", hybrid=False, top_k=1, allowed=store.allowed)
    assert store.answer(asked, 0)["hits"][0]["text"] == FACTS[1]
    other = store.answer(asked, 0, Elsewhere())
    assert (other["mode"], other["subqueries"], other["hits"][0]["text"]) == ("dense", 1, FACTS[2])


def test_backends_by_name(spark, tmp_path):
    assert isinstance(open_store(spark, f"file://{tmp_path}/m", allowed=("docs",)), Store)
    with pytest.raises(ValueError, match="parquet"):
        open_store(spark, "x", "tape")


def test_raw_scores_and_rrf_k(spark):
    rows = spark.createDataFrame([(i, "c", f"text {i}", [x, 1.0]) for i, x in enumerate((1.0, 0.5, -3.0))], "id long, collection string, text string, vector array<double>")
    queries = spark.createDataFrame([(0, 0, "text", [1.0, 0.0], ["c"])], "request_id int, query_id int, query_text string, vector array<double>, collections array<string>")
    assert [r.id for r in search.dense(rows, queries, 3, -1.0, raw=True).orderBy("rank").collect()] == [0, 1, 2]
    assert min(r.dense for r in search.candidates(rows, queries, 3, -1.0, raw=True).collect()) < 0 == min(r.dense for r in search.candidates(rows, queries, 3).collect())
    assert {r.id for r in search.candidates(rows, queries, 3, 0.0, raw=True).collect()} == {0, 1}
    mass = [search.hybrid(rows.withColumns({"importance": F.lit(None).cast("double"), "ts_ms": F.lit(None).cast("double"), "entities": F.array().cast("array<string>")}), queries, 1, 0, rrf_k=k).first().rrf for k in (1, 60)]
    assert mass[0] > 10 * mass[1]


def test_insert_overwrites_and_delete_removes(spark, store):
    store.ingest(docs(spark, FACTS), "docs")
    assert store.insert(files.items(spark, [{"text": FACTS[0], "metadata": {"importance": 9}}, {"text": FACTS[0]}, {"text": "  "}]), "docs") == 1
    rows = {r.text: r for r in store.rows("docs").collect()}
    assert len(rows) == 3 and json.loads(rows[FACTS[0]].meta_json) == {"importance": 9}
    with pytest.raises(P.RequestError):
        store.delete("docs")
    store.delete("docs", ids=["404"])
    store.delete("docs", ids=[rows[FACTS[1]].id], hashes=[rows[FACTS[2]].hash])
    assert [r.text for r in store.rows("docs").collect()] == [FACTS[0]]
    # an earlier version is still whole
    assert store.rows("docs", 1).count() == 3


def test_purge_lets_content_come_again(spark, store):
    store.ingest(docs(spark, FACTS[:1]), "docs")
    store.purge("docs")
    assert store.rows("docs").count() == 0 and store.stats().count() == 0
    assert counts(store.ingest(docs(spark, FACTS[:1]), "docs"))[0] == 1
    store.purge_all()
    assert store.stats().count() == 0


def test_missing_collections_are_empty_and_unknown_ones_an_error(spark, store):
    assert store.rows("lore").count() == 0 and store.list_hashes("lore").count() == 0
    store.delete("lore", ids=["1"])
    with pytest.raises(P.RequestError):
        store.rows("elsewhere")


def test_two_writers_cannot_make_one_version(spark, store):
    store.ingest(docs(spark, FACTS[:1]), "docs")
    with pytest.raises(Exception, match="[Ee]xist"):
        store._commit("docs", 0, [])


def test_metadata_keys_of_a_row_win(spark, store):
    store.insert(files.items(spark, [{"text": "some text of a row", "metadata": {"hash": "mine", "entities": ["A"], "ts": "12"}}]), "docs")
    hit = store.query(P.request("some text", collection="docs", allowed=store.allowed), 0).first()
    assert hit.metadata["hash"] == "mine" and hit.metadata["index"] == "0" and hit.entities == ["A"] and hit.ts_ms == 12.0


def test_stream_ingest_is_safe_to_repeat(spark, store, tmp_path):
    source = f"{tmp_path}/in"
    docs(spark, FACTS).write.parquet(source)
    stream = lambda: spark.readStream.schema("doc_pos long, text string, kind string, metadata string").parquet(source)
    for n in (1, 2):  # another checkpoint: everything is delivered again
        ingest_stream(stream(), store, "docs", f"{tmp_path}/check{n}").awaitTermination(120)
    assert store.rows("docs").count() == 3


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\nsome text")
    (tmp_path / "b.txt").write_text("  ")
    got = files.text_files(spark, f"file://{tmp_path}/*", importance=12).collect()
    assert len(got) == 1 and json.loads(got[0].metadata) == {"sourceName": "a.md", "sourceType": "upload", "importance": 10.0}
    assert "importance" not in json.loads(files.text_files(spark, f"file://{tmp_path}/a.md").first().metadata)
    assert json.loads(files.text_files(spark, f"file://{tmp_path}/a.md", importance=None).first().metadata)["importance"] == 0.0
    with pytest.raises(P.RequestError) as e:
        files.pdf_files(spark, str(tmp_path))
    assert e.value.status == 501
    pdf = files.pdf_files(spark, f"file://{tmp_path}/a.md", parse=lambda b: b.decode().upper()).first()
    assert pdf.text == "# TITLE\nSOME TEXT"
    import base64

    assert files.pdf_base64(spark, "x.pdf", base64.b64encode(b"hello").decode(), bytes.decode).first().text == "hello"
    for bad in ([], [{"text": "x"}] * 3):
        with pytest.raises(P.RequestError):
            files.documents(spark, bad, most=2)


def test_env_file(tmp_path):
    f = tmp_path / ".env"
    f.write_text("# note\nA=1\nexport B = 'two words'\nC=\"x\nA2=\n")
    assert config.read_env(str(f), {"A": "process"}) == {"A": "process", "B": "two words", "C": '"x', "A2": ""}
    assert config.read_env(str(tmp_path / "none"), {}) == {}


def test_secrets():
    assert config.redact("sk-1234567890") == "sk-1...90" and config.redact("short") == "***" and config.redact(7) == 7
    assert config.same_secret("a", "a") and not config.same_secret("a", "b") and not config.same_secret("a", "aa")


def test_refusals_are_read():
    now = 1_700_000_000.0
    assert E.reset_wait("30", now) == 30 and E.reset_wait(now + 12, now) == 12 and E.reset_wait((now + 5) * 1000, now) == pytest.approx(5)
    assert E.reset_wait("later", now) is None and E.reset_wait(-1, now) is None and E.reset_wait(now + 9000, now) is None
    assert E.retry_after({"Retry-After": "2"}) == 2 and E.retry_after({"X-RateLimit-Reset": "9"}, now) == 9 and E.retry_after({}) is None
    assert E.limiter({"X-RateLimit-Limit": "5"}, "HTTP 429: busy") == "account" and E.limiter({}, "HTTP 429: busy") == "upstream"
    assert E.limiter({}, '{"error_type": "rate_limit_exceeded"}') == "account" and E.limiter({}, "no") == "unknown"
    assert E.limiter({}, json.dumps({"error": {"message": "HTTP 429: slow down"}})) == "upstream"
    quoted = json.dumps({"error": {"metadata": {"raw": 'they say {"type": "rate_limit_error"}'}, "error_type": "rate_limit_exceeded"}})
    assert E.limiter({}, quoted) == "upstream"
    assert E.limiter({}, json.dumps([{"error": {"error_type": "rate_limit_exceeded"}}])) == "account"
    assert E.limiter({}, '{"type": "rate"}') == E.limiter({}, "HTTP 42: x") == E.limiter({}, "") == "unknown"
    assert [E.readable(x) for x in (250, 1500, 2000, 12_400, -3)] == ["250ms", "1.5s", "2s", "12s", "0ms"]
    assert all(0.5 * 2 ** (n - 1) <= E.refusal_wait(n) <= 0.55 * 2 ** (n - 1) for n in range(1, 8)) and E.refusal_wait(20) <= 132


def test_batch_plans():
    assert E.plan_batches([60, 60, 1], 64, 100) == [[0], [1, 2]]
    assert E.plan_batches([500, 1], 64, 100) == [[0], [1]]
    assert E.plan_batches([1] * 5, 2, 100) == [[0, 1], [2, 3], [4]] and E.plan_batches([]) == []


def test_vectors_are_validated():
    assert E.validate([[1.0, 2.0], [3.0, 4.0]]) == 2
    for bad in ([[1.0], [1.0, 2.0]], [[float("nan")]], ["AAAA"], [[1.0, None]]):
        with pytest.raises(P.RequestError) as e:
            E.validate(bad)
        assert e.value.status == 502


def test_distinct_texts_are_embedded_once_and_case_matters(spark):
    class Counting(E.MockEmbedder):
        def batch(self, texts):
            assert len(texts) == len(set(texts))
            return super().batch(texts)

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["Owl", "owl", "Owl", "hill", None])], "i int, text string")
    got = {r.i: r.vector for r in E.embed(rows, Counting()).collect()}
    assert len(got) == 5 and got[0] == got[2] and sum(got[4]) == 0


def test_a_bad_text_is_retried_alone_but_a_refusal_is_not():
    class Poison(E.MockEmbedder):
        calls = 0

        def batch(self, texts):
            Poison.calls += 1
            if len(texts) > 1:
                raise P.RequestError(self.status, "no")
            return super().batch(texts)

    Poison.status = 502
    assert len(Poison()(["a", "b", "c"])) == 3 and Poison.calls == 4
    Poison.status = 429
    with pytest.raises(P.RequestError):
        Poison()(["a", "b"])


def test_http_embedder_orders_by_index_and_waits():
    class Handler(BaseHTTPRequestHandler):
        seen = 0

        def do_POST(self):
            Handler.seen += 1
            if Handler.seen == 1:
                self.send_response(429)
                self.send_header("Retry-After", "0.05")
                self.end_headers()
                return
            n = len(json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"])
            body = json.dumps({"data": [{"index": i, "embedding": [float(i), 1.0]} for i in reversed(range(n))]}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    model = E.embedder("custom", url=f"http://127.0.0.1:{server.server_port}", model="m")
    assert model(["a", "b"]) == [[0.0, 1.0], [1.0, 1.0]] and Handler.seen == 2
    server.shutdown()
    with pytest.raises(P.RequestError):
        E.embedder("nobody")
    with pytest.raises(P.RequestError):
        E.embedder("custom", url="", model="m")


def test_ingest_operators(spark):
    items = spark.createDataFrame([(0, 1), (1, 2), (2, 1), (3, 9), (4, 9)], "pos int, hash long")
    stored = spark.createDataFrame([(9,)], "hash long")
    assert [r.pos for r in ingest.fresh(items, stored, ["pos"]).orderBy("pos").collect()] == [0, 1]
    assert counts(ingest.counters(items, stored)) == (2, 5, 2, 1, 3)
    assert counts(ingest.counters(items.limit(0), stored)) == (0, 0, 0, 0, 0)
