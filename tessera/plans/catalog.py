"""The registered queries and their SQL.

The retrieval corpus is ``documents`` joined with ``embeddings`` (row for row by
id): the language is the collection, importance comes from ``labels``, the time
stamp from ``events`` and the source is the entity.  The stated query set is every
corpus row whose id is divisible by 100; four neighbours of it make a request of
several sub-queries.  Queries run over whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.params import WEIGHTS
from ..functions.vector import clamped, finite, norm
from ..operators import buckets, chunker, embed, ingest, knn, rank
from ..sources.tables import table
from . import search

NOW_MS = 1735689600000.0
TOP_K = 5
ENTITIES = ("SRC0 ", "src7", " ")


# --- inputs ----------------------------------------------------------------


def _of(rows: DataFrame, ids: DataFrame | None) -> DataFrame:
    """The rows of some ids, or all."""
    return rows if ids is None else rows.join(ids, "id", "left_semi")


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("collection"), "text", F.array("source").alias("entities"))


def _base(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with their vectors."""
    docs = _texts(spark, sf)
    return docs.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")


def _corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with vectors and the fields that boosts read."""
    return _boosts(spark, sf, _base(spark, sf))


def _payload(spark: SparkSession, sf: str, ids: DataFrame) -> DataFrame:
    """Texts and the fields that boosts read of some ids."""
    return _boosts(spark, sf, _of(_texts(spark, sf), ids), ids)


def _boosts(spark: SparkSession, sf: str, base: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 7 + F.col("toxic") * 5).cast("double").alias("importance"))
    stamp = F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(ts as timestamp_ntz))").cast("double")
    events = table(spark, sf, "events").select(F.col("event_id").alias("id"), stamp.alias("ts_ms"))
    return base.join(_of(labels, ids), "id", "left").join(_of(events, ids), "id", "left")


def _queries(corpus: DataFrame, single: bool = False) -> DataFrame:
    collections = F.array(*[F.lit(c) for c in ("de", "en", "es", "fr")])
    request = F.col("id") if single else F.floor(F.col("id") / 400)
    return corpus.where("id % 100 = 0").select(request.cast("long").alias("request_id"), F.col("id").alias("query_id"), F.col("text").alias("query_text"), "vector", collections.alias("collections"))


def _requests(queries: DataFrame) -> DataFrame:
    return queries.select("request_id").distinct().withColumn("wanted", F.array(*[F.lit(e) for e in ENTITIES]))


def _pool(spark: SparkSession, sf: str):
    base = _base(spark, sf)
    queries = _queries(base)
    texts = lambda ids: _of(_texts(spark, sf).drop("entities"), ids)
    return search.candidates(texts, queries, 40, vectors=base.drop("entities")), queries


def _r(c, digits: int = 6):
    return F.round(c, digits)


# --- queries ---------------------------------------------------------------


def fnv1a_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.content_hash("text").alias("hash"))


def fnv1a_expression(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", X.fnv1a(F.col("text")).alias("hash"), X.units_length(F.col("text")).cast("long").alias("units"))


def tokenize_terms(spark, sf):
    tokens = table(spark, sf, "documents").select("doc_id", X.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def term_freq(spark, sf):
    tf = rank.term_frequencies(table(spark, sf, "documents"), ["doc_id"])
    return tf.groupBy("doc_id").agg(F.count("*").alias("terms"), F.max("tf").alias("max_tf"), F.sum(F.col("tf") * F.col("tf")).alias("tf_squares"))


def doc_freq(spark, sf):
    return rank.document_frequencies(table(spark, sf, "documents"))


def cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.lit("all").alias("collection"), F.col("embedding").alias("vector"))
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return knn.top_k_of_all(rows, queries, TOP_K).select("query_id", "id", _r("cosine").alias("cosine"), F.col("rank").cast("long").alias("rank"))


def cosine_topk_per_collection(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("collection"), F.col("embedding").alias("vector"))
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    best = knn.top_k_of_all(rows, queries, TOP_K)
    return best.select("query_id", "collection", "id", _r(clamped(F.col("cosine"))).alias("score"), F.col("rank").cast("long").alias("rank"))


def dense_threshold(spark, sf):
    base = _base(spark, sf)
    found = search.candidates(base, _queries(base), TOP_K, 0.1)
    return found.select("query_id", "collection", "id", F.col("pos").cast("long").alias("pos"), _r("dense").alias("dense"))


def dense_multi_query_merge(spark, sf):
    base = _base(spark, sf)
    return search.dense(base, _queries(base), TOP_K).select("request_id", "collection", "id", _r("dense").alias("dense"), F.col("rank").cast("long").alias("rank"))


def bm25_scores(spark, sf):
    pool, queries = _pool(spark, sf)
    return rank.bm25(pool, queries).select("request_id", "query_id", F.col("pos").cast("long").alias("pos"), "id", _r("bm25").alias("bm25"))


def ordinal_ranks(spark, sf):
    pool, queries = _pool(spark, sf)
    ranked = rank.rrf(rank.bm25(pool, queries))
    return ranked.select("query_id", "id", F.col("dense_rank").cast("long").alias("dense_rank"), F.col("bm25_rank").cast("long").alias("bm25_rank"))


def rrf_fusion(spark, sf):
    pool, queries = _pool(spark, sf)
    merged = rank.fuse(rank.rrf(rank.bm25(pool, queries)))
    return merged.select("request_id", "collection", "id", _r("rrf", 9).alias("rrf"), _r("bm25_best").alias("bm25_best"), _r("dense_best").alias("dense_best"))


def dual_signal_bonus(spark, sf):
    pool, queries = _pool(spark, sf)
    return rank.rrf(rank.bm25(pool, queries)).groupBy("query_id").agg(F.count_if("both").alias("dual"), F.count("*").alias("candidates"), _r(F.sum("rrf"), 9).alias("mass"))


def _hybrid(spark, sf, single):
    base = _base(spark, sf)
    queries = _queries(base, single)
    hits = search.hybrid(lambda ids: _payload(spark, sf, ids), queries, TOP_K, NOW_MS, _requests(queries), vectors=base)
    return hits.select("request_id", "collection", "id", F.col("rank").cast("long").alias("rank"), _r("final_score").alias("final_score"), _r("dense_best").alias("dense_score"), _r("bm25_best").alias("bm25_score"))


def hybrid_single_query(spark, sf):
    return _hybrid(spark, sf, True)


def hybrid_multi_query(spark, sf):
    return _hybrid(spark, sf, False)


def boost_importance(spark, sf):
    return _corpus(spark, sf).select("id", _r(rank.importance_term(F.col("importance"), WEIGHTS["importance"])).alias("term"))


def boost_recency(spark, sf):
    return _corpus(spark, sf).select("id", _r(rank.recency_term(F.col("ts_ms"), NOW_MS, WEIGHTS["recency"])).alias("term"))


def boost_entity(spark, sf):
    wanted = F.array(*[F.lit(e) for e in ENTITIES])
    return _corpus(spark, sf).select("id", rank.entity_term(F.col("entities"), wanted, WEIGHTS["entity"]).alias("term"))


def _items(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_pos"), "text", "lang", "source", X.content_hash("text").alias("hash"))


def ingest_fresh(spark, sf):
    items = _items(spark, sf)
    return ingest.fresh(items, items.where("source = 'src0'"), ["item_pos"]).select("item_pos", "hash")


def ingest_counters(spark, sf):
    items = _items(spark, sf)
    return ingest.counters(items, items.where("source = 'src0'"))


def insert_overwrite(spark, sf):
    items = ingest.first_of_hash(_items(spark, sf), ["item_pos"]).select("hash", "lang", F.lit("old").alias("state"))
    new = ingest.first_of_hash(_items(spark, sf).where("lang = 'de'"), ["item_pos"]).select("hash", "lang", F.lit("new").alias("state"))
    return ingest.upsert(items, new)


def delete_keys(spark, sf):
    items = _items(spark, sf).withColumn("id", F.col("hash").cast("string"))
    toxic = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_pos"))
    keys = items.join(toxic, "item_pos").select(F.col("id").alias("key"))
    return ingest.remove(items, keys.unionByName(keys)).select("item_pos", "hash")


def purge_collection(spark, sf):
    return _items(spark, sf).where("lang <> 'de'").groupBy("lang").agg(F.count("*").alias("count"))


def collection_stats(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("lang").alias("collection")).agg(F.count("*").alias("count"))


def list_hashes(spark, sf):
    return _items(spark, sf).where("lang = 'fr'").select("hash").where("hash is not null")


def dedup_texts(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    slots = docs.groupBy("text").agg(F.min("doc_id").alias("slot"), F.count("*").alias("uses"))
    return docs.join(slots, "text").select("doc_id", "slot", "uses")


def _chunked(docs: DataFrame) -> DataFrame:
    found = chunker.chunk(docs)
    return found.select(F.col("doc_pos").alias("doc_id"), F.col("idx").cast("long").alias("idx"), "kind", "hash", F.length("text").cast("long").alias("chars"), "metadata")


def chunk_prose(spark, sf):
    meta = F.to_json(F.struct("lang", F.lit("mine").alias("kind")))
    return _chunked(table(spark, sf, "documents").select(F.col("doc_id").alias("doc_pos"), "text", F.lit(None).cast("string").alias("kind"), meta.alias("metadata")))


def chunk_markdown_tables(spark, sf):
    row = lambda *c: F.concat(F.lit("| "), c[0], F.lit(" | "), c[1], F.lit(" |\n"))
    head = F.concat(F.lit("## Document "), F.col("doc_id").cast("string"), F.lit("\r\n"))
    text = F.concat(head, row(F.lit("id"), F.lit("lang")), F.lit("| --- | :--: |\n"), row(F.col("doc_id").cast("string"), F.col("lang")), F.lit("\n"), F.col("text"))
    return _chunked(table(spark, sf, "documents").select(F.col("doc_id").alias("doc_pos"), text.alias("text")))


def mock_embed(spark, sf):
    found = buckets.profile(table(spark, sf, "documents"), "doc_id")
    return found.select("doc_id", "buckets", _r("top_weight").alias("top_weight"), _r("checksum", 5).alias("checksum"))


def mock_cosine(spark, sf):
    """Benchmark items against all documents by the offline embedding."""
    model = embed.MockEmbedder()
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("all").alias("collection"), "text")
    queries = embed.embed(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text"), model).select("query_id", "vector")
    best = knn.top_k_of_all(embed.embed(docs, model), queries, 3)
    # stored vectors are floats: compare to four decimals, leave ties of the cut alone
    return best.groupBy("query_id").agg(_r(F.max("cosine"), 4).alias("best"), F.count("*").alias("hits"))


def validate_vectors(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.size("embedding").alias("dim"), finite(F.col("embedding")).alias("ok"), norm(F.col("embedding")).alias("size"))
    return rows.groupBy("dim").agg(F.count("*").alias("vectors"), F.count_if("ok").alias("finite"), _r(F.avg("size"), 5).alias("mean_norm"))


def batch_plan(spark, sf):
    """Batches of each conversation's turns for the embedder."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length(F.coalesce("text", F.lit(""))).alias("n")))).alias("turns"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            plans = [embed.plan_batches([t["n"] for t in turns], 3, 400) for turns in batch.column(1).to_pylist()]
            sizes = [[len(g) for g in p] for p in plans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sizes], pa.int64()), pa.array([max(s) for s in sizes], pa.int64())], names=["conv_id", "batches", "largest"])

    return turns.mapInArrow(run, "conv_id long, batches long, largest long")


QUERIES = {
    f.__name__: f
    for f in (
        fnv1a_hash, fnv1a_expression, tokenize_terms, term_freq, doc_freq, cosine_topk, cosine_topk_per_collection, dense_threshold,
        dense_multi_query_merge, bm25_scores, ordinal_ranks, rrf_fusion, dual_signal_bonus, hybrid_single_query, hybrid_multi_query,
        boost_importance, boost_recency, boost_entity, ingest_fresh, ingest_counters, insert_overwrite, delete_keys, purge_collection,
        collection_stats, list_hashes, dedup_texts, chunk_prose, chunk_markdown_tables, mock_embed, mock_cosine, validate_vectors, batch_plan,
    )
}


# --- the same in SQL -------------------------------------------------------

_HASH = "list_reduce(list_prepend(2166136261::BIGINT, [ord(c)::BIGINT for c in string_split({0}, '') if c <> '']), lambda h, u: (xor(h, u) * 16777619) % 4294967296)"
_STOP = "[" + ", ".join(f"'{w}'" for w in X.STOPWORDS) + "]"


def _tok(c: str) -> str:
    return f"[t for t in regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]+') if length(t) > 1 and not list_contains({_STOP}, t)]"


def _hash(c: str) -> str:
    return _HASH.replace("{0}", c)


_CORPUS = """
corpus AS (
  SELECT d.doc_id AS id, d.lang AS collection, d.text, [d.source] AS entities, e.embedding::DOUBLE[] AS v,
         (l.quality * 7 + l.toxic * 5)::DOUBLE AS importance, epoch_ms(ev.ts)::DOUBLE AS ts_ms
  FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN events ev ON ev.event_id = d.doc_id),
queries AS (SELECT REQUEST AS request_id, id AS query_id, text AS query_text, v FROM corpus WHERE id % 100 = 0),
near AS (
  SELECT request_id, query_id, c.collection, c.id, round(list_cosine_similarity(c.v, q.v), 10) AS cosine,
         row_number() OVER (PARTITION BY request_id, query_id, c.collection ORDER BY round(list_cosine_similarity(c.v, q.v), 10) DESC, c.id) AS rank
  FROM queries q, corpus c)"""


def _pool_sql(k: int, threshold: float = 0.0, single: bool = False) -> str:
    corpus = _CORPUS.replace("REQUEST", "id" if single else "id // 400")
    return f"""WITH {corpus},
pool AS (
  SELECT request_id, query_id, n.collection, n.id, greatest(0, least(1, cosine)) AS dense,
         row_number() OVER (PARTITION BY request_id, query_id ORDER BY n.collection, rank) - 1 AS pos
  FROM near n WHERE rank <= {k} AND greatest(0, least(1, cosine)) >= {threshold}::DOUBLE)"""


_LEXICAL = f"""{{0}},
tok AS (SELECT p.*, {_tok('c.text')} AS toks, count(*) OVER w AS n FROM pool p JOIN corpus c USING (collection, id) WINDOW w AS (PARTITION BY request_id, query_id)),
stat AS (SELECT *, len(toks)::DOUBLE AS dl, coalesce(nullif(sum(len(toks)) OVER w / n, 0), 1) AS mean FROM tok WINDOW w AS (PARTITION BY request_id, query_id)),
term AS (SELECT request_id, query_id, pos, term, count(*)::DOUBLE AS tf FROM (SELECT request_id, query_id, pos, unnest(toks) AS term FROM stat) GROUP BY ALL),
df AS (SELECT request_id, query_id, term, count(*)::DOUBLE AS df FROM term GROUP BY ALL),
asked AS (SELECT DISTINCT request_id, query_id, unnest({_tok('query_text')}) AS term FROM queries),
word AS (
  SELECT request_id, query_id, pos, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean))) AS bm25
  FROM asked JOIN term USING (request_id, query_id, term) JOIN df USING (request_id, query_id, term) JOIN stat USING (request_id, query_id, pos) GROUP BY ALL),
lex AS (SELECT s.request_id, s.query_id, s.pos, s.collection, s.id, s.dense, s.n, coalesce(bm25, 0) AS bm25 FROM stat s LEFT JOIN word USING (request_id, query_id, pos)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY request_id, query_id ORDER BY round(dense, 10) DESC, pos) - 1 AS dense_rank,
         row_number() OVER (PARTITION BY request_id, query_id ORDER BY round(bm25, 10) DESC, pos) - 1 AS bm25_rank FROM lex),
fusion AS (
  SELECT *, dense_rank < n / 2 AND bm25_rank < n / 2 AND bm25 > 0 AS dual,
         (1 / (61.0::DOUBLE + dense_rank) + 1 / (61.0::DOUBLE + bm25_rank)) * CASE WHEN dense_rank < n / 2 AND bm25_rank < n / 2 AND bm25 > 0 THEN 1.08::DOUBLE ELSE 1 END AS rrf FROM ranked),
merged AS (
  SELECT request_id, collection, id, sum(rrf) AS rrf, max(bm25) AS bm25_best, max(dense) AS dense_best, min((query_id, pos)) AS first FROM fusion GROUP BY ALL)"""


def _lexical(single: bool = False) -> str:
    return _LEXICAL.replace("{0}", _pool_sql(40, single=single))


_IMPORTANCE = "CASE WHEN importance IS NULL THEN 0 ELSE 0.25::DOUBLE * least(10, greatest(0, importance)) / 10 END"
_RECENCY = f"CASE WHEN ts_ms > 0 THEN 0.15::DOUBLE * pow(0.5::DOUBLE, greatest(0, ({NOW_MS}::DOUBLE - ts_ms) / 86400000) / 30) ELSE 0 END"
_ENTITY = "CASE WHEN list_has_any([trim(lower(e)) for e in entities], ['src0', 'src7']) THEN 0.2::DOUBLE ELSE 0 END"


def _hybrid_sql(single: bool) -> str:
    return f"""{_lexical(single)},
final AS (SELECT m.*, rrf + {_IMPORTANCE} + {_RECENCY} + {_ENTITY} AS final_score FROM merged m JOIN corpus c USING (collection, id)),
best AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(final_score, 10) DESC, first) AS rank FROM final)
SELECT request_id, collection, id, rank, round(final_score, 6) AS final_score, round(dense_best, 6) AS dense_score, round(bm25_best, 6) AS bm25_score FROM best WHERE rank <= {TOP_K}"""


def _windows(text: str, base: str) -> str:
    """Chunks of one-paragraph texts in closed form: base gives doc_id, lang, p."""
    return f"""
{base},
n AS (SELECT *, greatest(0, ceil((length(p) - 4800) / 2700.0))::BIGINT AS k FROM base WHERE p <> ''),
w AS (SELECT *, unnest(range(k + 1)) AS i FROM n),
c AS (SELECT doc_id, lang, i, {_trim("CASE WHEN i < k THEN substr(p, i * 2700 + 1, 3200) ELSE substr(p, i * 2700 + 1) END")} AS {text} FROM w)"""


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[\\s\\x{{00A0}}\\x{{FEFF}}]+|[\\s\\x{{00A0}}\\x{{FEFF}}]+$', '', 'g')"


_BASE = f"WITH base AS (SELECT doc_id, lang, {_trim('text')} AS p FROM documents)"
_ITEMS = f"WITH items AS (SELECT doc_id AS item_pos, lang, source, {_hash('text')} AS hash FROM documents)"

ORACLES = {
    "fnv1a_hash": f"SELECT doc_id, {_hash('text')} AS hash FROM documents",
    "fnv1a_expression": f"SELECT item_id, {_hash('text')} AS hash, length(text) AS units FROM benchmark",
    "tokenize_terms": f"SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tok('text')} AS t FROM documents)",
    "term_freq": f"""SELECT doc_id, count(*) AS terms, max(tf) AS max_tf, sum(tf * tf)::BIGINT AS tf_squares FROM
        (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY doc_id""",
    "doc_freq": f"SELECT term, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({_tok('text')}) AS term FROM documents) GROUP BY term",
    "cosine_topk": f"""SELECT query_id, id, round(cosine, 6) AS cosine, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM (
          SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 10) AS cosine
          FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= {TOP_K}""",
    "cosine_topk_per_collection": f"""SELECT query_id, collection, id, round(greatest(0, least(1, cosine)), 6) AS score, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY cosine DESC, id) AS rank FROM (
          SELECT q.vec_id AS query_id, e.label::VARCHAR AS collection, e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 10) AS cosine
          FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE rank <= {TOP_K}""",
    "dense_threshold": f"{_pool_sql(TOP_K, 0.1)} SELECT query_id, collection, id, pos, round(dense, 6) AS dense FROM pool",
    "dense_multi_query_merge": f"""{_pool_sql(TOP_K)},
        once AS (SELECT *, row_number() OVER (PARTITION BY request_id, collection, id ORDER BY round(dense, 10) DESC, query_id, pos) AS r FROM pool),
        best AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY round(dense, 10) DESC, query_id, pos) AS rank FROM once WHERE r = 1)
        SELECT request_id, collection, id, round(dense, 6) AS dense, rank FROM best WHERE rank <= {TOP_K}""",
    "bm25_scores": f"{_lexical()} SELECT request_id, query_id, pos, id, round(bm25, 6) AS bm25 FROM lex",
    "ordinal_ranks": f"{_lexical()} SELECT query_id, id, dense_rank, bm25_rank FROM ranked",
    "rrf_fusion": f"{_lexical()} SELECT request_id, collection, id, round(rrf, 9) AS rrf, round(bm25_best, 6) AS bm25_best, round(dense_best, 6) AS dense_best FROM merged",
    "dual_signal_bonus": f"{_lexical()} SELECT query_id, count_if(dual)::BIGINT AS dual, count(*) AS candidates, round(sum(rrf), 9) AS mass FROM fusion GROUP BY query_id",
    "hybrid_single_query": _hybrid_sql(True),
    "hybrid_multi_query": _hybrid_sql(False),
    "boost_importance": f"WITH {_CORPUS.replace('REQUEST', 'id')} SELECT id, round({_IMPORTANCE}, 6) AS term FROM corpus",
    "boost_recency": f"WITH {_CORPUS.replace('REQUEST', 'id')} SELECT id, round({_RECENCY}, 6) AS term FROM corpus",
    "boost_entity": f"WITH {_CORPUS.replace('REQUEST', 'id')} SELECT id, {_ENTITY}::DOUBLE AS term FROM corpus",
    "ingest_fresh": f"{_ITEMS} SELECT min(item_pos) AS item_pos, hash FROM items WHERE hash NOT IN (SELECT hash FROM items WHERE source = 'src0') GROUP BY hash",
    "ingest_counters": f"""{_ITEMS}, known AS (SELECT DISTINCT hash FROM items WHERE source = 'src0'),
        m AS (SELECT i.hash, k.hash IS NOT NULL AS stored FROM items i LEFT JOIN known k USING (hash)),
        t AS (SELECT count(DISTINCT hash) FILTER (NOT stored) AS inserted, count(*) AS chunks, count_if(stored)::BIGINT AS already_stored, count_if(NOT stored)::BIGINT AS fresh FROM m)
        SELECT inserted, chunks, already_stored, fresh - inserted AS repeats, already_stored + fresh - inserted AS skipped FROM t""",
    "insert_overwrite": f"""{_ITEMS}, old AS (SELECT hash, arg_min(lang, item_pos) AS lang, 'old' AS state FROM items GROUP BY hash),
        new AS (SELECT hash, 'de' AS lang, 'new' AS state FROM items WHERE lang = 'de' GROUP BY hash)
        SELECT * FROM old WHERE hash NOT IN (SELECT hash FROM new) UNION ALL SELECT * FROM new""",
    "delete_keys": f"""{_ITEMS} SELECT item_pos, hash FROM items WHERE hash NOT IN
        (SELECT hash FROM items JOIN labels ON doc_id = item_pos WHERE toxic = 1)""",
    "purge_collection": "SELECT lang, count(*) AS count FROM documents WHERE lang <> 'de' GROUP BY lang",
    "collection_stats": "SELECT lang AS collection, count(*) AS count FROM documents GROUP BY lang",
    "list_hashes": f"SELECT {_hash('text')} AS hash FROM documents WHERE lang = 'fr'",
    "dedup_texts": "SELECT doc_id, min(doc_id) OVER w AS slot, count(*) OVER w AS uses FROM documents WINDOW w AS (PARTITION BY text)",
    "chunk_prose": f"""{_windows('t', _BASE)}
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, 'prose' AS kind, {_hash('t')} AS hash, length(t) AS chars,
               '{{"lang":"' || lang || '","kind":"prose"}}' AS metadata FROM c WHERE length(t) >= 24""",
    "chunk_markdown_tables": f"""{_windows('t', _BASE)},
        tab AS (SELECT doc_id, -1 AS i, 'table' AS kind, 'Document ' || doc_id || chr(10) || '| id | lang |' || chr(10) || '| --- | :--: |' || chr(10) || '| ' || doc_id || ' | ' || lang || ' |' AS t FROM documents),
        a AS (SELECT * FROM tab UNION ALL SELECT doc_id, i, 'prose', t FROM c WHERE length(t) >= 24)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS idx, kind, {_hash('t')} AS hash, length(t) AS chars, '{{"kind":"' || kind || '"}}' AS metadata FROM a""",
    "mock_embed": f"""WITH w AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL),
        h AS (SELECT DISTINCT token, {_hash('token')} % 256 AS bucket FROM w),
        s AS (SELECT doc_id, bucket, sum(n)::DOUBLE AS n FROM w JOIN h USING (token) GROUP BY ALL),
        x AS (SELECT doc_id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS w FROM s)
        SELECT doc_id, count(*) AS buckets, round(max(w), 6) AS top_weight, round(sum(w * (bucket + 1)), 5) AS checksum FROM x GROUP BY doc_id""",
    "mock_cosine": f"""WITH t AS (SELECT 'd' AS what, doc_id AS id, text FROM documents UNION ALL SELECT 'q', item_id, text FROM benchmark),
        w AS (SELECT what, id, token, count(*) AS n FROM (SELECT what, id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM t) GROUP BY ALL),
        h AS (SELECT DISTINCT token, {_hash('token')} % 256 AS bucket FROM w),
        s AS (SELECT what, id, bucket, sum(n)::DOUBLE AS n FROM w JOIN h USING (token) GROUP BY ALL),
        x AS (SELECT what, id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY what, id)) AS w FROM s),
        p AS (SELECT q.id AS query_id, d.id, sum(q.w * d.w) AS cosine FROM x q JOIN x d USING (bucket) WHERE q.what = 'q' AND d.what = 'd' GROUP BY ALL)
        SELECT query_id, round(max(cosine), 4) AS best, 3::BIGINT AS hits FROM p GROUP BY query_id""",
    "batch_plan": """WITH RECURSIVE t AS (
          SELECT conv_id, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, n) AS i, count(*) OVER (PARTITION BY conv_id) AS turns
          FROM (SELECT conv_id, turn, length(coalesce(text, ''))::BIGINT AS n FROM conversations)),
        s(conv_id, i, turns, batches, held, room, largest) AS (
          SELECT conv_id, i, turns, 1::BIGINT, 1::BIGINT, 400 - n, 1::BIGINT FROM t WHERE i = 1
          UNION ALL
          SELECT t.conv_id, t.i, t.turns, CASE WHEN s.held >= 3 OR t.n > s.room THEN s.batches + 1 ELSE s.batches END,
                 CASE WHEN s.held >= 3 OR t.n > s.room THEN 1 ELSE s.held + 1 END, CASE WHEN s.held >= 3 OR t.n > s.room THEN 400 - t.n ELSE s.room - t.n END,
                 greatest(s.largest, CASE WHEN s.held >= 3 OR t.n > s.room THEN 1 ELSE s.held + 1 END)
          FROM s JOIN t ON t.conv_id = s.conv_id AND t.i = s.i + 1)
        SELECT conv_id, batches, largest FROM s WHERE i = turns""",
    "validate_vectors": """SELECT len(embedding)::INTEGER AS dim, count(*) AS vectors, count_if(len([x for x in embedding if isfinite(x)]) = len(embedding))::BIGINT AS finite,
        round(avg(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS mean_norm FROM embeddings GROUP BY 1""",
}
