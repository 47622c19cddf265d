"""Documents from files and requests."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import MAX_DOCUMENTS, RequestError, number
from ..functions.text import js_trim


def documents(spark: SparkSession, docs: list[dict], most: int | None = MAX_DOCUMENTS) -> DataFrame:
    """A request's documents as (doc_pos, text, kind, metadata).  ``most`` guards
    a request; tables of any size are DataFrames to begin with."""
    if not docs:
        raise RequestError(400, "documents are required")
    if most is not None and len(docs) > most:
        raise RequestError(413, "too many documents")
    rows = [(i, d["text"], d.get("kind"), json.dumps(d["metadata"]) if d.get("metadata") else None) for i, d in enumerate(docs) if isinstance(d, dict) and isinstance(d.get("text"), str) and d["text"].strip()]
    return spark.createDataFrame(rows, "doc_pos long, text string, kind string, metadata string")


def _upload(rows: DataFrame, importance) -> DataFrame:
    """(name, text) rows as uploaded documents; files without text are an error
    only where none is left, as the caller's ingest then counts no chunks."""
    fields = [F.col("name").alias("sourceName"), F.lit("upload").alias("sourceType")]
    if importance != "absent":
        value = number(importance)
        if value == value and abs(value) != float("inf"):
            fields.append(F.lit(max(0.0, min(10.0, value))).alias("importance"))
    kept = rows.where(js_trim("text") != "")
    return kept.select(F.xxhash64("name").alias("doc_pos"), "text", F.lit(None).cast("string").alias("kind"), F.to_json(F.struct(*fields)).alias("metadata"))


def text_files(spark: SparkSession, path: str, importance="absent") -> DataFrame:
    """Whole text files (TXT, MD, CSV, JSON) as documents."""
    rows = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))
    return _upload(rows, importance)


def pdf_files(spark: SparkSession, path: str, parse: Callable[[bytes], str] | None = None, importance="absent") -> DataFrame:
    """PDF files as documents; ``parse`` turns a file's bytes into text."""
    if parse is None:
        raise RequestError(501, "reading PDF files needs a parser")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [parse(x.as_py()) or "" for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["name", "text"])

    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return _upload(found.mapInArrow(run, "name string, text string"), importance)


def pdf_base64(spark: SparkSession, filename: str, data: str, parse: Callable[[bytes], str] | None = None, importance="absent") -> DataFrame:
    """One uploaded PDF, its bytes as base64 text."""
    import base64

    if parse is None:
        raise RequestError(501, "reading PDF files needs a parser")
    if not data:
        raise RequestError(400, "data is required for a PDF")
    text = parse(base64.b64decode(data)) or ""
    if not text.strip():
        raise RequestError(400, "no extractable text")
    return _upload(spark.createDataFrame([(filename, text)], "name string, text string"), importance)


def items(spark: SparkSession, raw: list[dict]) -> DataFrame:
    """Pre-chunked items of a request: (item_pos, text, idx, hash, metadata)."""
    rows, pos = [], 0
    finite = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool) and x == x and abs(x) != float("inf")
    for it in raw or []:
        if not (isinstance(it, dict) and isinstance(it.get("text"), str) and it["text"].strip()):
            continue
        meta = it.get("metadata")
        rows.append((pos, it["text"], int(it["index"]) if finite(it.get("index")) else pos, int(it["hash"]) if finite(it.get("hash")) else None, json.dumps(meta) if isinstance(meta, (dict, list)) else "{}"))
        pos += 1
    return spark.createDataFrame(rows, "item_pos long, text string, idx int, hash long, metadata string")
