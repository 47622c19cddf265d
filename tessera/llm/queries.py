"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.scratch import new_path
from ..sources.tables import table
from . import decontam, exact_dedup, html_main, jaccard, lm_score, packing, passage_dedup, suffix_dedup, toxicity, warc


def op1_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.classify(table(spark, sf_dir, "documents"))


def op5_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    found = warc.read(spark, path, payload=False)
    return found.select(F.col("id").alias("page_id"), "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


def op6_decontaminate(spark, sf_dir):
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    n_items = F.size("items").cast("long")
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), n_items.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"),
    )


def op3_passage_dedup(spark, sf_dir):
    return passage_dedup.passages(table(spark, sf_dir, "documents"))


def packed(docs):
    """Pieces of whole documents, with the digest of their ids."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark, sf_dir):
    return jaccard.components_of(table(spark, sf_dir, "documents"))


def fold(column: str, folds: int):
    """crc32 of a column's text, modulo ``folds``."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def op8_html_extraction(spark, sf_dir):
    return html_main.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op9_lm_scoring(spark, sf_dir):
    return lm_score.scores(table(spark, sf_dir, "documents"), fold("doc_id", 10) == 0)


def toxicity_model(spark, sf_dir):
    """Learned from the labels outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0)
    return toxicity.fit(table(spark, sf_dir, "documents"), labels)


def op10_toxicity(spark, sf_dir):
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup, "op2_exact_dedup": op2_exact_dedup, "op3_passage_dedup": op3_passage_dedup, "op4_packing": op4_packing, "op5_warc": op5_warc, "op6_decontaminate": op6_decontaminate, "op7_jaccard_join": op7_jaccard_join, "op8_html_extraction": op8_html_extraction, "op9_lm_scoring": op9_lm_scoring, "op10_toxicity": op10_toxicity}

_OP2 = r"""
    WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
    FROM n WINDOW w AS (PARTITION BY t)
"""

_OP1 = r"""
    WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 200) AS g FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS s FROM d WHERE length(h) >= 200)),
    late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
    step AS (SELECT doc_id, s, s > lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) + 100 AS new FROM late),
    run AS (SELECT doc_id, s, count_if(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM step),
    span AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM run GROUP BY doc_id, k),
    gap AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM span),
    cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
            FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
    FROM d LEFT JOIN cut USING (doc_id)
"""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6 = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(8, len(w)) AS k, unnest([w[i : i + least(8, len(w)) - 1] for i in range(1, len(w) - least(8, len(w)) + 2)]) AS g FROM b WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT k FROM win),
    pos AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k),
    hit AS (SELECT doc_id, i, pos.k, item_id FROM pos JOIN win ON win.k = pos.k AND win.g = pos.w[i : i + pos.k - 1]),
    word AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM hit) GROUP BY doc_id),
    item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
           sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
    FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""

_OP7 = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, unnest([w[i : i + least(5, len(w)) - 1] for i in range(1, len(w) - least(5, len(w)) + 2)]) AS g FROM d WHERE len(w) > 0),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
    e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
    r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
    SELECT id AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = id GROUP BY id
"""

_OP5 = r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    q AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS top FROM p)
    SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
           CASE WHEN n < 1000 OR page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN n < 1000 OR page_id = top THEN NULL ELSE top END AS refers_to
    FROM q
"""

ORACLES = {"op1_suffix_dedup": _OP1, "op2_exact_dedup": _OP2, "op5_warc": _OP5, "op6_decontaminate": _OP6, "op7_jaccard_join": _OP7}
