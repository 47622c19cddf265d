"""Benchmark decontamination by winnowing.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased.  A window is ``WINDOW`` consecutive words of a benchmark item; an
item with fewer words, but not none, is one window.

Both sides hash every run of ``GRAM`` words and keep the smallest hash of each
sliding window of ``WINDOW - GRAM + 1`` hashes.  Equal spans of ``WINDOW`` words
hold equal hashes, so they keep the same one: every shared span of that length
has a common fingerprint.  Fingerprints are joined, and each hit is extended to
the whole window by comparing the window's own hash.  Items too short for a
winnowing window are fingerprinted by the one gram that they consist of.

The words of a hit are compared with the window's, so a clash of hashes is no hit.

A benchmark whose windows take at most ``BROADCAST_BYTES`` (summed first) is sent
to the executors.  A larger one is joined by a shuffle on the fingerprint: a
document sends one row for each fingerprint that it keeps, with the hashes of the
windows that keep it, and the words are compared where the hits meet the text
again.  A fingerprint that many documents keep is split by adaptive execution,
whose skew join must be on.

Cases: a null text has no words and no hits; a null item id counts as the empty
string; rows that repeat a document are judged each by its own text; an empty
benchmark hits nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import settle
from . import kernel as K

WINDOW = 8
GRAM = 5
BROADCAST_BYTES = 64 << 20
#: Bytes that a window takes beside its words, and windows that a row of the shuffle holds.
_OVERHEAD, _ROW_WINDOWS = 200, 64

SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _smallest(grams: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = grams[:n].copy()
    for j in range(1, w):
        np.minimum(out, grams[j : j + n], out=out)
    return out


def _inside(woff: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of the first n word positions start k words of one document."""
    ok = np.zeros(n, bool)
    sizes = np.maximum(np.diff(woff) - k + 1, 0)
    first = np.repeat(woff[:-1], sizes)
    step = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ok[first + step] = True
    return ok


def _words(data: np.ndarray, offs: np.ndarray):
    starts, ends, woff = K.word_spans(data, offs, K.ALNUM | (K.LOWER != np.arange(256)))
    return K.word_hashes(data, starts, ends), woff, starts, ends


def _windows(words: np.ndarray, woff: np.ndarray, window: int, gram: int):
    """Fingerprint and hash of each full window, with its first word."""
    full = K.gram_hashes(words, window)
    prints = _smallest(K.gram_hashes(words, gram), window - gram + 1)
    at = np.flatnonzero(_inside(woff, window, len(full)))
    return prints[at], full[at], at


def _short(words: np.ndarray, woff: np.ndarray, k: int):
    full = K.gram_hashes(words, k)
    at = np.flatnonzero(_inside(woff, k, len(full)))
    return full[at], at


_ITEM_ROWS = "fingerprint long, hash long, words int, item string, text binary"


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row for each window of each item: fingerprint, hash, words, item, and the
    text, its words with blanks between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            data, offs = K.text_bytes(batch.column(1))
            for i in range(len(ids)):
                own = data[offs[i] : offs[i + 1]]
                words, woff, starts, ends = _words(own, np.array([0, len(own)]))
                n = len(words)
                if n == 0:
                    continue
                if n >= window:
                    prints, full, _ = _windows(words, woff, window, gram)
                else:
                    full = K.gram_hashes(words, n)
                    prints = full
                low = K.LOWER[own]
                spelled = [low[a:z].tobytes() for a, z in zip(starts, ends)]
                texts = [b" ".join(spelled[j : j + min(n, window)]) for j in range(len(full))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints.view(np.int64)), pa.array(full.view(np.int64)), pa.array(np.full(len(full), min(n, window), np.int32)), pa.array([ids[i]] * len(full), pa.string()), pa.array(texts, pa.binary())],
                    names=["fingerprint", "hash", "words", "item", "text"],
                )

    rows = benchmark.select(F.coalesce(benchmark[id_col].cast("string"), F.lit("")), benchmark[text_col].cast("string"))
    return rows.mapInArrow(run, _ITEM_ROWS).distinct()


class _Windows:
    """Windows of one size as arrays, sorted by hash."""

    def __init__(self, hashes, prints, items: list, texts: list):
        known: dict[tuple[int, bytes], list] = {}
        for h, item, text in sorted(zip(hashes.tolist(), items, texts)):
            known.setdefault((h, text), []).append(item)
        self.items = list(known.values())
        self.hashes, self.first, self.times = np.unique(np.array([h for h, _ in known], np.uint64), return_index=True, return_counts=True)
        spelled = [text.split(b" ") for _, text in known]
        self.sizes = np.array([[len(w) for w in words] for words in spelled], np.int64)
        self.bytes = np.frombuffer(b"".join(b"".join(words) for words in spelled), np.uint8)
        self.total = self.sizes.sum(1)
        self.place = np.cumsum(self.total) - self.total
        self.prints = np.unique(prints)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.prints >> np.uint64(44)).astype(np.int64)] = True

    def equal(self, low, starts, ends, at, which) -> np.ndarray:
        """Whether the words from ``at`` on are those of the windows ``which``."""
        word = at[:, None] + np.arange(self.sizes.shape[1])
        same = (ends[word] - starts[word] == self.sizes[which]).all(1)
        x = np.flatnonzero(same)
        if len(x):
            word, which = word[x].ravel(), which[x]
            differ = _gather(low, starts[word], ends[word] - starts[word]) != _gather(self.bytes, self.place[which], self.total[which])
            same[x] = ~np.logical_or.reduceat(differ, np.cumsum(self.total[which]) - self.total[which])
        return same


def _gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    first = np.cumsum(size) - size
    return data[np.repeat(at - first, size) + np.arange(int(size.sum()))]


class _Index:
    """The benchmark's windows by their number of words."""

    def __init__(self, rows: pa.Table, window: int, gram: int):
        self.window, self.gram = window, gram
        items, texts = np.array(rows["item"].to_pylist(), object), np.array(rows["text"].to_pylist(), object)
        hashes = rows["hash"].to_numpy().view(np.uint64)
        sizes = rows["words"].to_numpy()
        prints = rows["fingerprint"].to_numpy().view(np.uint64)
        self.by_size = {}
        for k in sorted(set(sizes.tolist())):
            here = sizes == k
            self.by_size[int(k)] = _Windows(hashes[here], prints[here], items[here].tolist(), texts[here].tolist())

    def hits(self, data: np.ndarray, words: np.ndarray, woff: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(words, first word of every hit, its window, the windows of that size)."""
        low = None
        for k, own in self.by_size.items():
            if k == self.window:
                prints, full, at = _windows(words, woff, self.window, self.gram)
            else:
                full, at = _short(words, woff, k)
                prints = full
            maybe = np.flatnonzero(own.seen[(prints >> np.uint64(44)).astype(np.int64)])
            maybe = maybe[_member(prints[maybe], own.prints) >= 0]
            found = _member(full[maybe], own.hashes)  # the hit, extended to the window
            yes = found >= 0
            if not yes.any():
                continue
            low = K.LOWER[data] if low is None else low
            at, found = at[maybe[yes]], found[yes]
            for turn in range(int(own.times[found].max())):  # several windows only where hashes clash
                x = np.flatnonzero(own.times[found] > turn)
                which = own.first[found[x]] + turn
                x, which = (y[own.equal(low, starts, ends, at[x], which)] for y in (x, which))
                if len(x):
                    yield k, at[x], which, own.items


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Place of each value in the sorted array, -1 where it is absent."""
    if not len(among):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return np.where(among[at] == values, at, -1)


def _merged(first: np.ndarray, last: np.ndarray) -> list[dict]:
    """Union of word ranges as maximal runs (adjacent ones join)."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    cut = np.flatnonzero(first[1:] > last[:-1] + 1) + 1
    return [{"first": int(a), "last": int(b)} for a, b in zip(first[np.r_[0, cut]], last[np.r_[cut - 1, len(last) - 1]])]


def _scan(column, index: _Index):
    """Words, merged hit ranges and items of each text."""
    data, offs = K.text_bytes(column)
    n_words = np.zeros(len(offs) - 1, np.int64)
    spans: list[list] = [[] for _ in range(len(offs) - 1)]
    items: list[list] = [[] for _ in range(len(offs) - 1)]
    for i, j in K.chunks(offs):
        words, woff, starts, ends = _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        n_words[i:j] = np.diff(woff)
        got: dict[int, list] = {}
        for k, at, found, lists in index.hits(data[offs[i] : offs[j]], words, woff, starts, ends):
            doc = np.searchsorted(woff, at, "right") - 1
            for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1):
                d = int(doc[cut[0]])
                got.setdefault(d, []).append((at[cut] - woff[d], at[cut] - woff[d] + k - 1, {x for f in set(found[cut].tolist()) for x in lists[f]}))
        for d, parts in got.items():
            spans[i + d] = _merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            items[i + d] = sorted(set().union(*(p[2] for p in parts)))
    return n_words, spans, items


def _index(windows: DataFrame, limit: int, window: int, gram: int) -> _Index | None:
    """The windows on the driver if they take at most ``limit`` bytes, else None."""
    size = windows.agg(F.sum(F.length("text") + F.octet_length("item") + _OVERHEAD)).first()[0]
    if (size or 0) > limit:
        return None
    return _Index(windows.toArrow(), window, gram)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: id, n_words, spans (hit word ranges, counted from 0)
    and items (ids of the items with occurring windows, sorted as strings)."""
    windows = benchmark_windows(benchmark, item_col, item_text_col, window, gram)
    index = _index(windows, broadcast_bytes, window, gram)
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("__text"))
    if index is None:
        return _joined(rows, windows, id_col, window, gram)
    held = docs.sparkSession.sparkContext.broadcast(index)
    schema = T.StructType([rows.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])

    def run(batches):
        for batch in batches:
            n_words, spans, items = _scan(batch.column(1), held.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words), pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))], names=[id_col, "n_words", "spans", "items"]
            )

    return rows.mapInArrow(run, schema)


def _joined(rows: DataFrame, windows: DataFrame, id_col: str, window: int, gram: int) -> DataFrame:
    """The same by a shuffle on fingerprints, for a benchmark of any size."""
    windows = settle(windows, "decontam-windows")
    sizes = sorted(r[0] for r in windows.select("words").distinct().collect())  # at most ``window`` values
    # written, so that a row's number is the same whenever it is read
    rows = settle(rows.withColumn("__row", F.monotonically_increasing_id()), "decontam-rows")

    def prints(batches):
        names = ["__row", "fingerprint", "words", "first", "hashes"]
        for batch in batches:
            key = batch.column(1).to_numpy()
            data, offs = K.text_bytes(batch.column(0))
            for i, j in K.chunks(offs):
                words, woff, _, _ = _words(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                for k in sizes:
                    if k == window:
                        fp, full, at = _windows(words, woff, window, gram)
                    else:
                        full, at = _short(words, woff, k)
                        fp = full
                    if not len(at):
                        continue
                    # windows in a row that keep one fingerprint travel as one
                    doc = np.searchsorted(woff, at, "right") - 1
                    edge = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(doc) != 0) | (fp[1:] != fp[:-1])])
                    inner = np.arange(len(at)) - np.repeat(edge, np.diff(np.r_[edge, len(at)]))
                    edge = np.flatnonzero(inner % _ROW_WINDOWS == 0)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[edge, len(at)].astype(np.int32)), pa.array(full.view(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key[i + doc[edge]]), pa.array(fp[edge].view(np.int64)), pa.array(np.full(len(edge), k, np.int32)), pa.array(at[edge] - woff[doc[edge]]), lists], names=names
                    )

    def verified(batches):
        for batch in batches:
            data, offs = K.text_bytes(batch.column(1))
            n_words, spans, items = [], [], []
            for i, hits in enumerate(batch.column(2).to_pylist()):
                own = data[offs[i] : offs[i + 1]]
                _, _, starts, ends = _words(own, np.array([0, len(own)]))
                n_words.append(len(starts))
                low = K.LOWER[own] if hits else own
                spelled: dict[tuple[int, int], bytes] = {}
                real = []
                for h in hits or []:
                    place = (h["at"], h["words"])
                    if place not in spelled:
                        spelled[place] = b" ".join(low[a:z].tobytes() for a, z in zip(starts[place[0] : sum(place)], ends[place[0] : sum(place)]))
                    if spelled[place] == h["text"]:
                        real.append((*place, h["item"]))
                at = np.array([r[0] for r in real], np.int64)
                spans.append(_merged(at, at + np.array([r[1] for r in real], np.int64) - 1) if real else [])
                items.append(sorted({r[2] for r in real}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))], names=[id_col, "n_words", "spans", "items"])

    kept = rows.select("__text", "__row").mapInArrow(prints, "__row long, fingerprint long, words int, first long, hashes array<long>")
    met = kept.join(windows, ["fingerprint", "words"])
    places = F.filter(F.sequence(F.lit(0), F.size("hashes") - 1), lambda i: F.col("hashes")[i] == F.col("hash"))
    hits = met.withColumn("__at", F.explode(places)).select("__row", "words", "item", "text", (F.col("first") + F.col("__at")).alias("at"))
    found = hits.groupBy("__row").agg(F.collect_set(F.struct("at", "words", "item", "text")).alias("hits"))
    schema = T.StructType([rows.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])
    return rows.join(found, "__row", "left").select(id_col, "__text", "hits").mapInArrow(verified, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_items: int = 2, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` with windows of fewer than ``min_items`` items, columns unchanged."""
    windows = benchmark_windows(benchmark, item_col, item_text_col, window, gram)
    index = _index(windows, broadcast_bytes, window, gram)
    if index is None:
        marked = settle(docs.withColumn("__mark", F.monotonically_increasing_id()), "decontam-docs")
        found = _joined(marked.select(F.col("__mark"), F.col(text_col).cast("string").alias("__text")), windows, "__mark", window, gram)
        bad = found.where(F.size("items") >= min_items).select("__mark")
        return marked.join(bad, "__mark", "left_anti").drop("__mark")
    held = docs.sparkSession.sparkContext.broadcast(index)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            items = _scan(batch.column(place).cast(pa.string()), held.value)[2]
            yield batch.filter(pa.array([len(x) < min_items for x in items], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
