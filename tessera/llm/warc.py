"""Content-addressed web archive.

Payload bytes are stored once: the record that stands for a payload is a
``response`` with the bytes, every other one a ``revisit`` of headers alone.
Payloads are equal when their bytes are (the payload itself is a grouping key
beside its SHA-256; a digest that two payloads share stops the write), and only
payloads of at least ``LEAST`` bytes are shared.  Reading verifies every payload
against its digest and rebuilds the original records by joining headers with
payloads.

An archive folder holds WARC/1.1 files: ``payloads/`` the responses, about
``FILE_BYTES`` a file by the mean payload, ``headers/`` the revisits.  A record
ends in CR LF CR LF, which is the line end given to Spark's text writer and
reader, so files are read as streams: a task puts the pieces together again by
Content-Length and holds one record and a batch, however long a file is, and a
payload may hold any text.

The grouping combines equal payloads in each task before its one shuffle, so a
payload of a third of all pages arrives once a task.  The join of headers with
digests has plain shuffles, which adaptive execution splits.

Cases: a null payload is empty; a null url becomes an empty one; line breaks in
an url become blanks; a null id is smaller than any other and reads back as
null; of rows that repeat an id and payload one is the response and the others
revisit it; an empty table gives an empty archive; other columns aren't archived.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST = 1000
FILE_BYTES = 32 << 20
HEADS_A_FILE = 100_000
#: Records and bytes that are handed on at a time.
_ROWS, _BYTES = 500, 8 << 20
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("null"))


def _record(kind: str, lines: list[tuple[str, Column]], block: Column) -> Column:
    """One WARC record as text, without the line ends that close it."""
    parts = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}")]
    for name, value in [*lines, ("Content-Length", F.octet_length(block).cast("string"))]:
        parts += [F.lit(f"\r\n{name}: "), value]
    return F.concat(*parts, F.lit(_END), block)


def _head(date: str) -> list[tuple[str, Column]]:
    return [
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), _text("id"), F.lit(">"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("sha256"))),
    ]


def _http(payload: str) -> Column:
    size = F.octet_length(payload).cast("string")
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(_END), F.col(payload))


def _save(records: DataFrame, path: str, file_records: int) -> None:
    records.write.option("lineSep", _END).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", *, least: int = LEAST, date: str = "1970-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> None:
    """Archive a table in a new folder of a file system that the cluster shares."""
    spark = pages.sparkSession
    rows = pages.select(
        pages[id_col].cast("long").alias("id"),
        F.coalesce(pages[url_col].cast("string"), F.lit("")).alias("url"),
        F.coalesce(pages[payload_col].cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"sha256": F.sha2(F.col("payload").cast("binary"), 256), "large": F.octet_length("payload") >= least})
    shared = rows.where("large").groupBy("sha256", "payload").agg(F.max(F.struct("id", "url")).alias("own")).select("own.id", "own.url", "payload", "sha256")
    responses = shared.unionByName(rows.where("not large").select("id", "url", "payload", "sha256"))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    mean = rows.agg(F.avg(F.octet_length("payload"))).first()[0] or 0.0
    _save(responses.select(_record("response", [*_head(date), kind], _http("payload"))), f"{path}/payloads", max(1, int(file_bytes / (mean + 600))))

    # the responses as archived say which record stands for a digest
    keepers = parse(spark, f"{path}/payloads", payload=False).where(F.col("payload_bytes") >= least)
    keepers = keepers.select("sha256", F.struct(F.col("id").alias("id"), F.col("url").alias("url")).alias("own"))
    several = keepers.groupBy("sha256").count().where("count > 1")
    if not several.isEmpty():
        raise ValueError("two different payloads have one SHA-256")
    times = rows.where("large").groupBy("sha256", "id", "url").agg(F.count("*").alias("n"))
    met = times.join(keepers, "sha256").withColumn("is_own", F.col("id").eqNullSafe(F.col("own.id")) & (F.regexp_replace("url", r"[\r\n]", " ") == F.col("own.url")))
    again = met.withColumn("n", F.col("n") - F.col("is_own").cast("long")).where("n > 0")
    again = again.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    refers = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("own.id").cast("string"), F.lit("null")), F.lit(">"))
    lines = [*_head(date), ("WARC-Profile", F.lit(_PROFILE)), ("WARC-Refers-To", refers)]
    _save(again.select(_record("revisit", lines, F.lit(""))), f"{path}/headers", HEADS_A_FILE)


def records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of WARC files, given as the pieces between
    their CR LF CR LFs."""
    end = _END.encode()
    held, head, first, need = bytearray(), {}, 0, 0  # need: bytes of the record that is being read
    for piece in pieces:
        held += piece
        held += end
        while held and len(held) >= need:
            if not need:
                if held.startswith(end):  # a payload that ends in CR LF shifts the last cut of a file
                    del held[: len(end)]
                    continue
                stop = held.index(end)
                lines = held[:stop].decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError("not a WARC record")
                head = dict(x.split(": ", 1) for x in lines[1:])
                first = stop + len(end)
                need = first + int(head["Content-Length"]) + len(end)
            if len(held) >= need:
                if held[need - len(end) : need] != end:
                    raise ValueError("a record's length is wrong")
                yield head, bytes(held[first : need - len(end)])
                del held[:need]
                need = 0
    if held:
        raise ValueError("the last record is cut short")


def _page(value: str | None) -> int | None:
    """The page id of a record id such as <urn:page:7>."""
    inner = value.rsplit(":", 1)[1][:-1] if value else "null"
    return None if inner == "null" else int(inner)


_PARSED = [("id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("sha256", T.StringType()), ("sha1", T.StringType()), ("payload_bytes", T.LongType()), ("payload", T.StringType())]


def parse(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the WARC files in a folder.  A response's payload is checked
    against its digest; its SHA-1 and length are taken from the bytes."""
    names = [n for n, _ in _PARSED]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def run(batches):
        rows, size = [], 0
        pieces = (x.as_py() for batch in batches for x in batch.column(0).cast(pa.binary()))
        for head, block in records(pieces):
            digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
            common = (_page(head["WARC-Record-ID"]), head["WARC-Target-URI"], head["WARC-Type"])
            if head["WARC-Type"] == "response":
                body = block[block.index(_END.encode()) + 4 :]
                if hashlib.sha256(body).hexdigest() != digest:
                    raise ValueError(f"damaged payload: {head['WARC-Record-ID']}")
                rows.append((*common, None, digest, hashlib.sha1(body).hexdigest(), len(body), body.decode("utf-8") if payload else None))
                size += len(body) * payload
            else:
                rows.append((*common, _page(head["WARC-Refers-To"]), digest, None, None, None))
            if len(rows) >= _ROWS or size >= _BYTES:
                yield table(rows)
                rows, size = [], 0
        if rows:
            yield table(rows)

    files = spark.read.option("lineSep", _END).option("pathGlobFilter", "*.gz").text(path)
    return files.mapInArrow(run, T.StructType([T.StructField(n, k) for n, k in _PARSED]))


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The original records: id, url, record_type, refers_to, sha256, sha1,
    payload_bytes and, if asked for, payload (joined to the revisits)."""
    own = parse(spark, f"{path}/payloads", payload)
    bytes_of = ["sha1", "payload_bytes"] + ["payload"] * payload
    revisits = parse(spark, f"{path}/headers", False).select("id", "url", "record_type", "refers_to", "sha256")
    # revisits name stored payloads only: one response for each of their digests
    stored = own.select("sha256", F.col("id").alias("refers_to"), *bytes_of)
    rebuilt = revisits.withColumn("__to", F.col("refers_to")).drop("refers_to").join(stored.withColumnRenamed("refers_to", "__own"), "sha256")
    rebuilt = rebuilt.where(F.col("__to").eqNullSafe(F.col("__own"))).withColumnRenamed("__to", "refers_to")
    columns = ["id", "url", "record_type", "refers_to", "sha256", *bytes_of]
    return own.select(*columns).unionByName(rebuilt.select(*columns))
