"""Collections as snapshot-versioned Parquet tables.

A collection is a folder of immutable parts and numbered manifests; a manifest
lists the parts of a version, and the highest number is the current one.  A
write first stores its part and then creates the next manifest, which fails if
another writer was faster, so a reader sees a whole version or the one before.

New rows are appended as a part of their own.  Only a write that replaces or
removes stored rows copies the collection (into the next version, never in place:
a plan must not overwrite the files that it reads).
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.params import COLLECTIONS, Request, RequestError, safe_collection
from ..functions.text import content_hash, js_trim
from ..operators import chunker, embed, ingest
from ..plans import search

ROW = "id string, hash long, text string, idx int, meta_json string, vector array<float>"
_locks: dict[str, threading.Lock] = {}


class Store:
    """The verbs of the collections under ``path``, a shared file system."""

    def __init__(self, spark: SparkSession, path: str, model: embed.Embedder | None = None, allowed=COLLECTIONS):
        self.spark, self.path, self.model, self.allowed = spark, path.rstrip("/"), model or embed.MockEmbedder(), tuple(allowed)

    # files

    def _hadoop(self, path: str):
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, collection: str) -> str:
        return f"{self.path}/{safe_collection(collection, self.allowed)}"

    def _versions(self, collection: str) -> list[int]:
        where, fs = self._hadoop(f"{self._folder(collection)}/manifests")
        if not fs.exists(where):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))

    def _parts(self, collection: str, version: int | None = None) -> tuple[int, list[str]]:
        versions = self._versions(collection)
        if not versions:
            return 0, []
        version = versions[-1] if version is None else version
        raw = self.spark.read.text(f"{self._folder(collection)}/manifests/{version}.json", wholetext=True).first()
        return version, json.loads(raw[0])

    def _commit(self, collection: str, base: int, parts: list[str]) -> None:
        """Version base + 1; raises if there is one already."""
        where, fs = self._hadoop(f"{self._folder(collection)}/manifests/{base + 1}.json")
        out = fs.create(where, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()

    def _lock(self, collection: str) -> threading.Lock:
        return _locks.setdefault(self._folder(collection), threading.Lock())

    def _write(self, collection: str, rows: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        rows.select("id", "hash", "text", "idx", "meta_json", "vector").write.parquet(f"{self._folder(collection)}/{part}")
        return part

    # reading

    def rows(self, collection: str, version: int | None = None) -> DataFrame:
        """The stored rows; a collection never written is empty."""
        _, parts = self._parts(collection, version)
        if not parts:
            return self.spark.createDataFrame([], ROW)
        return self.spark.read.schema(ROW).parquet(*[f"{self._folder(collection)}/{p}" for p in parts])

    def list_hashes(self, collection: str) -> DataFrame:
        return self.rows(collection).select("hash").where("hash is not null")

    def stats(self) -> DataFrame:
        """collection, count of the collections that exist."""
        there = [c for c in self.allowed if self._versions(c)]
        out = self.spark.createDataFrame([], "collection string, count long")
        for c in there:  # at most the allow-list
            out = out.unionByName(self.rows(c).agg(F.count("*").alias("count")).select(F.lit(c).alias("collection"), "count"))
        return out

    # writing

    def _embedded(self, items: DataFrame) -> DataFrame:
        rows = items.select(F.col("hash").cast("string").alias("id"), "hash", "text", F.col("idx").cast("int").alias("idx"), F.coalesce("metadata", F.lit("{}")).alias("meta_json"))
        return embed.embed(rows, self.model)

    def ingest(self, documents: DataFrame, collection: str, options: chunker.Options = chunker.Options()) -> DataFrame:
        """Chunk, leave out what is stored or repeated, embed, append.

        Returns one row: inserted, chunks, skipped, already_stored, repeats."""
        with self._lock(collection):
            base, parts = self._parts(collection)
            stored = self.rows(collection).select("hash")
            items = chunker.chunk(documents.where(js_trim(F.coalesce("text", F.lit(""))) != ""), options).persist()
            try:
                counts = ingest.counters(items, stored).first()
                if counts["inserted"]:
                    part = self._write(collection, self._embedded(ingest.fresh(items, stored, ["doc_pos", "idx"])))
                    self._commit(collection, base, [*parts, part])
            finally:
                items.unpersist()
        return self.spark.createDataFrame([counts])

    def insert(self, items: DataFrame, collection: str) -> int:
        """Make the rows be exactly these: stored rows of the same hash go."""
        text = items.where(js_trim(F.coalesce("text", F.lit(""))) != "")
        rows = ingest.first_of_hash(text.withColumn("hash", F.coalesce("hash", content_hash("text"))), ["item_pos"])
        return self._upsert(rows, collection)

    def _upsert(self, rows: DataFrame, collection: str) -> int:
        with self._lock(collection):
            base, parts = self._parts(collection)
            part = self._write(collection, self._embedded(rows))
            new = self.spark.read.schema(ROW).parquet(f"{self._folder(collection)}/{part}")
            n = new.count()
            if not n:
                return 0
            old = self.rows(collection)
            if not old.join(new.select("hash"), "hash", "left_semi").isEmpty():
                parts = [self._write(collection, old.join(new.select("hash"), "hash", "left_anti"))]
            self._commit(collection, base, [*parts, part])
            return n

    def delete(self, collection: str, ids=(), hashes=()) -> None:
        """Remove rows by id or hash; keys that match nothing are no error."""
        keys = {str(i) for i in ids} | {str(int(h)) for h in hashes}
        if not keys:
            raise RequestError(400, "ids or hashes are required")
        self.delete_keys(collection, self.spark.createDataFrame([(k,) for k in sorted(keys)], "key string"))

    def delete_keys(self, collection: str, keys: DataFrame) -> None:
        """The same for a table of keys of any size."""
        with self._lock(collection):
            base, parts = self._parts(collection)
            if parts:
                self._commit(collection, base, [self._write(collection, ingest.remove(self.rows(collection), keys))])

    def purge(self, collection: str) -> None:
        where, fs = self._hadoop(self._folder(collection))
        with self._lock(collection):
            fs.delete(where, True)

    def purge_all(self) -> None:
        for c in self.allowed:
            self.purge(c)

    # search

    def corpus(self, collections: list[str]) -> DataFrame:
        """Rows of the collections with the typed fields that scoring reads."""
        out = None
        for c in dict.fromkeys(collections):
            rows = self.rows(c).withColumn("collection", F.lit(c))
            out = rows if out is None else out.unionByName(rows)
        field = lambda name: F.get_json_object("meta_json", f"$.{name}")
        number = lambda x: F.when(js_trim(x) == "", 0.0).otherwise(x.try_cast("double"))
        stamp = F.coalesce(field("ts"), field("startTs"), field("updatedAt"))
        return out.select(
            F.col("hash").alias("id"), "collection", "text", "hash", "idx", "meta_json", "vector", number(field("importance")).alias("importance"),
            number(stamp).alias("ts_ms"), F.from_json(field("entities"), "array<string>").alias("entities"),
        )

    def query(self, request: Request, now_ms: float, model: embed.Embedder | None = None) -> DataFrame:
        """Hits of one request: collection, id, text, hash, metadata, scores, rank.
        ``model`` embeds this request's texts in place of the store's own."""
        if not request.collections:
            return self.spark.createDataFrame([], "collection string, id long, text string, rank int")
        vectors = (model or self.model)(request.texts)
        rows = [(0, i, t, [float(x) for x in v], request.collections) for i, (t, v) in enumerate(zip(request.texts, vectors))]
        queries = self.spark.createDataFrame(rows, "request_id int, query_id int, query_text string, vector array<float>, collections array<string>")
        corpus = self.corpus(request.collections)
        if request.hybrid:
            wanted = self.spark.createDataFrame([(0, request.entities)], "request_id int, wanted array<string>")
            hits = search.hybrid(corpus, queries, request.top_k, now_ms, wanted, request.weights)
        else:
            hits = search.dense(corpus, queries, request.top_k, request.threshold)
        return hits.withColumn("metadata", merged_metadata()).orderBy("rank")


    def answer(self, request: Request, now_ms: float, model: embed.Embedder | None = None) -> dict:
        """The answer to one request: hits (at most its top_k), mode, subqueries."""
        hits = [r.asDict(True) for r in self.query(request, now_ms, model).collect()]
        return {"hits": hits, "mode": "hybrid" if request.hybrid else "dense", "subqueries": len(request.texts)}


BACKENDS = {"parquet": Store}


def open_store(spark: SparkSession, path: str, backend: str = "parquet", **options) -> Store:
    """The store of a backend by its name."""
    if backend not in BACKENDS:
        raise ValueError(f'Unknown backend "{backend}"; known: {", ".join(BACKENDS)}')
    return BACKENDS[backend](spark, path, **options)


def merged_metadata():
    """A hit's metadata: hash, text and index under the row's own fields, which win."""
    own = F.from_json("meta_json", "map<string,string>")
    base = F.create_map(F.lit("hash"), F.col("hash").cast("string"), F.lit("text"), F.col("text"), F.lit("index"), F.col("idx").cast("string"))
    own = F.coalesce(own, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(own, k)), own)
