"""Toxicity scores of noisily written text.

Restoring: a token that may be disguised (letters mixed with look-alike signs, a
letter three times or more in a row, or letters spelled one by one) becomes a
character lattice.  Each sign may stand for itself or for the letters it looks
like, a repeated letter may be kept or dropped, and separators between single
letters may be dropped; every such step has a channel cost.  Viterbi decoding
finds the cheapest path under a character trigram model of all documents.

Scoring: a word gives the features "whole word" and "starts with" (3 to 10
bytes), from the written and from the restored text, each once for occurring at
all and once for being dense (in ``DENSE`` of the text's words or more).  Learning is sequential
covering on labelled texts: the feature that covers most of the toxic texts not
covered yet joins the list while its precision's lower bound stays above
``PRECISION``; a score is the noisy-or of the features present.

What is learned: the trigram counts cover every document.  The labels come from
a bounded sample of the rows given as labelled: at most ``TOXIC_ROWS`` toxic and
``CLEAN_ROWS`` clean ones, those with the smallest hash of their id.  The model
is a few hundred numbers and is sent to the executors.

Cases: a null or empty text gets the background score; rows with a null label
teach nothing; a null id is kept; without toxic labels every text gets the
background score; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K

TOXIC_ROWS = 2000
CLEAN_ROWS = 8000
PRECISION = 0.75
LEAST = 5
SUPPORT = 0.005
DENSE = 1 / 250
PREFIXES = (3, 4, 5, 6, 7, 8, 9, 10)

# Signs and the letters that they are written for.
LOOKALIKES = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l",
}

SUBSTITUTE, DROP, KEEP_SIGN, SEPARATOR = 1.0, 0.7, 2.5, 0.2

# --- character model -------------------------------------------------------

#: Classes of bytes: 0 all that is outside a word, 1-26 letters, 27-36 digits, the rest of UTF-8 by its low bits.
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[48:58] = np.arange(27, 37)
CLASS[128:] = 37 + np.arange(128) % 27
CLASSES = 64
_BLOCK = 4096


def _trigram_counts(data: np.ndarray) -> np.ndarray:
    c = CLASS[data]
    if len(c) < 3:
        return np.zeros(CLASSES**3, np.int64)
    return np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)


def trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of class trigrams over all texts (blocks of a fixed table are
    added up across tasks; 2 MB reach the driver)."""

    def count(batches):
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            data, offs = K.text_bytes(batch.column(0))
            for i, j in K.chunks(offs):
                total += _trigram_counts(np.concatenate([[32], data[offs[i] : offs[j]], [32]]).astype(np.uint8))
        blocks = total.reshape(-1, _BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks), dtype=np.int32)), pa.array([b.tobytes() for b in blocks], pa.binary())], names=["block", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[b] = sums.get(b, 0) + np.frombuffer(raw.as_buffer(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["block", "counts"])

    parts = docs.select(docs[text_col].cast("string")).mapInArrow(count, "block int, counts binary")
    n = CLASSES**3 // _BLOCK
    merged = parts.repartition(n, "block").mapInArrow(add, "block int, counts binary")
    out = np.zeros((n, _BLOCK), np.int64)
    for row in merged.collect():  # ``n`` rows, whatever the corpus
        out[row["block"]] += np.frombuffer(row["counts"], np.int64)
    return out.reshape(CLASSES, CLASSES, CLASSES)


def language_model(counts: np.ndarray) -> np.ndarray:
    """-log P(c | a, b): trigrams backed by bigrams and single characters."""
    one = counts.sum((0, 1)) + 0.5
    one = one / one.sum()
    two = counts.sum(0) + 20 * one
    two = two / two.sum(1, keepdims=True)
    three = counts + 10 * two[None]
    return (-np.log(three / three.sum(2, keepdims=True))).astype(np.float32)


def _code(ch: str) -> list[int]:
    return [int(CLASS[b]) for b in ch.encode()]


def restore(token: str, cost: np.ndarray) -> str:
    """The likeliest reading of a disguised token.

    States are the last two emitted classes; each sign extends every state by
    its readings."""
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    before = ""
    for ch in token:
        readings: list[tuple[str, float]] = []
        if ch.isalpha():
            readings.append((ch, 0.0))
            if ch == before:
                readings.append(("", DROP))
        elif ch in LOOKALIKES:
            readings += [(x, SUBSTITUTE) for x in LOOKALIKES[ch]]
            readings.append((ch, KEEP_SIGN) if ch.isdigit() else ("", KEEP_SIGN))
            if ch == before:
                readings.append(("", DROP))
        elif ch.isdigit():
            readings.append((ch, 0.0))
        else:
            readings.append(("", SEPARATOR))
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (so_far, text) in best.items():
            for out, price in readings:
                x, y, total = a, b, so_far + price
                for c in _code(out):
                    total += float(cost[x, y, c])
                    x, y = y, c
                if (x, y) not in new or total < new[x, y][0]:
                    new[x, y] = (total, text + out)
        best, before = new, ch
    return min((total + float(cost[a, b, 0]), text) for (a, b), (total, text) in best.items())[1]


_SIGNS = re.escape("".join(LOOKALIKES))
_LETTER = r"[^\W\d_]"
#: A token that may be disguised: letters one by one, signs among letters, or a letter three times.
DISGUISED = re.compile(
    rf"(?<!\w)[\w{_SIGNS}](?:[ .\-_*]{{1,2}}[\w{_SIGNS}]){{2,}}(?!\w)"
    rf"|(?:{_LETTER}+[{_SIGNS}]|[{_SIGNS}]+{_LETTER})[\w{_SIGNS}]*"
    rf"|\w*({_LETTER})\1\1\w*"
)
#: What a character is to the pattern, as bits; read off the pattern's own classes.
_WORD, _ALPHA, _SIGN, _JOINER, _LOW = 1, 2, 4, 8, 16
_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    """The kinds of every code point; made once a process."""
    if not _kinds:
        every = "".join(map(chr, range(0x110000)))
        kinds = np.zeros(len(every), np.uint8)
        for bit, pattern in ((_WORD, r"\w"), (_ALPHA, _LETTER), (_SIGN, f"[{_SIGNS}]"), (_JOINER, r"[ .\-_*]"), (_LOW, "_")):
            for m in re.finditer(f"(?:{pattern})+", every):
                kinds[m.start() : m.end()] |= bit
        _kinds.append(kinds)
    return _kinds[0]


def _suspicious(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Which texts the pattern can match: a sign beside a letter, a letter three
    times in a row, or three single characters between joiners.  None that the
    pattern matches is left out; texts are parted, so that no run crosses a border."""
    n = len(offs) - 1
    texts = [data[a:b].tobytes().decode("utf-8", "replace").lower() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
    place = np.cumsum([1] + [len(t) + 1 for t in texts])  # one past the borders
    codes = np.frombuffer("\n".join(["", *texts, *[""] * 8]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kind_table()[codes]
    alpha, sign, joiner = (kind & _ALPHA) > 0, (kind & _SIGN) > 0, (kind & _JOINER) > 0
    hits = [np.flatnonzero((sign[:-1] & alpha[1:]) | (alpha[:-1] & sign[1:]))]
    same = codes[:-1] == codes[1:]
    hits.append(np.flatnonzero(alpha[:-2] & same[:-1] & same[1:]))
    # single characters: the first follows no word, the last is before none (a low line may join on)
    single, word = (kind & (_WORD | _SIGN)) > 0, (kind & _WORD) > 0
    last = single[:-1] & ~(word[1:] & ((kind[1:] & _LOW) == 0))
    first = np.flatnonzero(single[1:-8] & ~word[:-9] & joiner[2:-7]) + 1
    for s in (2, 3):
        x = first if s == 2 else first[joiner[first + 2]]
        x = x[single[x + s] & joiner[x + s + 1]]
        hits.append(x[last[x + s + 2]])
        hits.append(x[joiner[x + s + 2] & last[x + s + 3]])
    out = np.zeros(n, bool)
    out[np.searchsorted(place, np.concatenate(hits), "right") - 1] = True
    return out


class Restorer:
    """Restores the disguised tokens of texts; remembers recent tokens."""

    def __init__(self, cost: np.ndarray, remember: int = 50_000):
        self.cost, self.remember, self.known = cost, remember, {}

    def __call__(self, text: str) -> str:
        """The restored readings of the text's disguised tokens, in order."""
        found = []
        for m in DISGUISED.finditer(text.lower()):
            token = m.group(0)
            got = self.known.get(token)
            if got is None:
                if len(self.known) >= self.remember:
                    self.known.clear()
                got = self.known[token] = restore(token, self.cost)
            if got != token:
                found.append(got)
        return " ".join(found)


# --- features --------------------------------------------------------------


def _features(data: np.ndarray, offs: np.ndarray):
    """For each kind of feature: hash of each word's feature, word places and word offsets."""
    starts, ends, woff = K.word_spans(data, offs, K.ALNUM | (K.LOWER != np.arange(256)))
    prefix = K.prefix_hash(data, K.BYTE_CODE_LOWER)
    size = ends - starts
    even = ~np.uint64(1)
    yield K.mix(K.span_hash(prefix, starts, ends) ^ np.uint64(0xA5A5)) & even, np.arange(len(starts)), woff
    for k in PREFIXES:
        at = np.flatnonzero(size > k)
        yield K.mix(K.span_hash(prefix, starts[at], starts[at] + k) ^ np.uint64(k)) & even, at, woff


@dataclass
class Model:
    cost: np.ndarray
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))  # -log(1 - p), where it occurs and where it is dense
    background: float = 0.01

    def seen(self) -> np.ndarray:
        out = np.zeros(1 << 20, bool)
        out[(self.feature >> np.uint64(44)).astype(np.int64)] = True
        return out

    def _present(self, data, offs, table) -> tuple[list[dict[int, int]], np.ndarray]:
        """For each text the occurrences of the model's features, and its words."""
        out: list[dict[int, int]] = [{} for _ in range(len(offs) - 1)]
        words = np.zeros(len(offs) - 1, np.int64)
        for hashes, at, woff in _features(data, offs):
            words = np.diff(woff)
            if not len(self.feature):
                continue
            maybe = np.flatnonzero(table[(hashes >> np.uint64(44)).astype(np.int64)])
            where = np.minimum(np.searchsorted(self.feature, hashes[maybe]), len(self.feature) - 1)
            yes = self.feature[where] == hashes[maybe]
            for d, f in zip((np.searchsorted(woff, at[maybe[yes]], "right") - 1).tolist(), where[yes].tolist()):
                out[d][f] = out[d].get(f, 0) + 1
        return out, words

    def scores(self, column, restorer: Restorer, table: np.ndarray) -> np.ndarray:
        data, offs = K.text_bytes(column)
        out = np.zeros(len(offs) - 1)
        for i, j in K.chunks(offs):
            own = offs[i : j + 1] - offs[i]
            part = data[offs[i] : offs[j]]
            found, words = self._present(part, own, table)
            odd = np.flatnonzero(_suspicious(part, own))
            texts = [restorer(part[own[d] : own[d + 1]].tobytes().decode("utf-8", "replace")) for d in odd]
            more, more_offs = K.text_bytes(pa.array(texts, pa.string()))
            for d, extra in zip(odd.tolist(), self._present(more, more_offs, table)[0]):
                for f, n in extra.items():
                    found[d][f] = found[d].get(f, 0) + n
            for d, f in enumerate(found):
                total = -math.log1p(-self.background)
                for x in sorted(f):
                    total += self.weight[x, 1 if f[x] >= DENSE * words[d] else 0]
                out[i + d] = -math.expm1(-total)
        return out


def _distinct(column, restorer: Restorer) -> list[np.ndarray]:
    """Distinct feature hashes of each text, written and restored: each feature
    that occurs, and once more, with the lowest bit turned, where it is dense."""
    out = []
    for x in column:
        text = x.as_py() or ""
        both = np.frombuffer(f"{text} {restorer(text)}".encode(), np.uint8)
        parts, words = [np.zeros(0, np.uint64)], 0
        for h, _, woff in _features(both, np.array([0, len(both)])):
            words = int(woff[-1])
            parts.append(h)
        any_of, n = np.unique(np.concatenate(parts), return_counts=True)
        out.append(np.unique(np.concatenate([any_of, any_of[n >= DENSE * words] ^ np.uint64(1)])))
    return out


def candidates(toxic: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """The features that enough toxic texts hold, sorted, and how many that is."""
    least = max(LEAST, SUPPORT * len(toxic))
    if not toxic:
        return np.zeros(0, np.uint64), least
    feature, count = np.unique(np.concatenate(toxic), return_counts=True)
    return feature[count >= least], least


def cover(feature: np.ndarray, least: float, held: list[np.ndarray], clean: list[np.ndarray], toxic_share: float):
    """Sequential covering: chosen features, their precision, the rate left over.

    held, clean: places in ``feature`` of each toxic and clean text; toxic_share:
    of all labelled rows, for which the two samples stand."""
    if not len(feature):
        return np.zeros(0, np.uint64), np.zeros(0), toxic_share
    against = np.zeros(len(feature))
    for x in clean:
        against[x] += 1
    wt = toxic_share / len(held)
    wc = (1 - toxic_share) / max(1, len(clean))
    remain = np.zeros(len(feature))
    for x in held:
        remain[x] += 1
    left = list(range(len(held)))
    chosen: list[int] = []
    odds: list[float] = []
    support = remain.copy()
    # precision with one clean and a half toxic text added, as a lower bound
    bound = (support * wt) / ((support + 0.5) * wt + (against + 1) * wc)
    usable = bound >= PRECISION
    while True:
        gain = np.where(usable, remain * bound, 0)
        f = int(np.argmax(gain))
        if remain[f] < least or gain[f] <= 0:
            break
        chosen.append(f)
        odds.append(float((support[f] + 0.5) * wt / ((support[f] + 0.5) * wt + (against[f] + 0.5) * wc)))
        rest = []
        for d in left:
            if np.any(held[d] == f):
                remain[held[d]] -= 1
            else:
                rest.append(d)
        left = rest
        usable[f] = False
    got = np.array(chosen, np.int64)
    in_clean = sum(1 for x in clean if not np.isin(x, got).any())
    background = (len(left) + 0.5) * wt / ((len(left) + 0.5) * wt + (in_clean + 0.5) * wc)
    order = np.argsort(feature[got])
    return feature[got][order], np.array(odds)[order], min(background, 0.49)


def _places(x: np.ndarray, feature: np.ndarray) -> np.ndarray:
    if not len(feature):
        return np.zeros(0, np.int32)
    at = np.minimum(np.searchsorted(feature, x), len(feature) - 1)
    return at[feature[at] == x].astype(np.int32)


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", *, toxic_rows: int = TOXIC_ROWS, clean_rows: int = CLEAN_ROWS) -> Model:
    """Learn from ``labelled`` (id, label) rows, texts from ``docs``."""
    cost = language_model(trigrams(docs, text_col))
    rows = labelled.select(labelled[id_col].alias("__id"), labelled[label_col].cast("int").alias("__label")).where("__label is not null and __id is not null")
    counts = {r["__label"]: r["count"] for r in rows.where("__label in (0, 1)").groupBy("__label").count().collect()}  # at most two rows
    if not counts.get(1):
        return Model(cost)
    by_hash = F.xxhash64("__id")
    sample = rows.where("__label = 1").orderBy(by_hash, "__id").limit(toxic_rows).unionByName(rows.where("__label = 0").orderBy(by_hash, "__id").limit(clean_rows)).dropDuplicates(["__id"])
    texts = docs.select(docs[id_col].alias("__id"), docs[text_col].cast("string").alias("__text"))
    texts = texts.join(F.broadcast(sample), "__id")  # at most toxic_rows + clean_rows ids
    share = counts[1] / sum(counts.values())

    def learn(batches):
        """Toxic texts come first; of clean ones only the candidates are kept."""
        restorer = Restorer(cost)
        toxic: list[np.ndarray] = []
        clean: list[np.ndarray] = []
        feature = None
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                part = batch.slice(i, 100)
                for x, label in zip(_distinct(part.column(0), restorer), part.column(1).to_pylist()):
                    if label == 1:
                        toxic.append(x)
                        continue
                    if feature is None:
                        feature, least = candidates(toxic)
                        toxic = [_places(y, feature) for y in toxic]
                    clean.append(_places(x, feature))
        if feature is None:
            feature, least = candidates(toxic)
            toxic = [_places(y, feature) for y in toxic]
        chosen, p, background = cover(feature, least, toxic, clean, share)
        yield pa.RecordBatch.from_arrays([pa.array([chosen.tobytes()], pa.binary()), pa.array([p.tobytes()], pa.binary()), pa.array([background])], names=["f", "p", "b"])

    # the sample has a fixed size, so one task learns; copies of a text teach once
    one = texts.groupBy("__text").agg(F.max("__label").alias("__label")).coalesce(1).sortWithinPartitions(F.desc("__label"))
    got = one.mapInArrow(learn, "f binary, p binary, b double").collect()
    if not got:
        return Model(cost)
    chosen = np.frombuffer(got[0]["f"], np.uint64)
    weight = -np.log1p(-np.minimum(np.frombuffer(got[0]["p"]), 1 - 1e-6))
    feature, place = np.unique(chosen & ~np.uint64(1), return_inverse=True)
    table = np.zeros((len(feature), 2))
    dense = (chosen & np.uint64(1)) == 1
    np.add.at(table[:, 1], place[dense], weight[dense])
    np.add.at(table[:, 0], place[~dense], weight[~dense])
    table[:, 1] += table[:, 0]
    return Model(cost, feature, table, got[0]["b"])


def _scorer(model: Model, spark):
    held = spark.sparkContext.broadcast(model)
    return lambda: (held.value, Restorer(held.value.cost), held.value.seen())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score (0 to 1, higher for toxic)."""
    rows = docs.select(docs[id_col].alias(id_col), docs[text_col].cast("string").alias("__text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("score", T.DoubleType())])
    ready = _scorer(model, docs.sparkSession)

    def run(batches):
        own, restorer, table = ready()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.scores(batch.column(1), restorer, table))], names=[id_col, "score"])

    return rows.mapInArrow(run, schema)


def reject(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, columns unchanged."""
    place = docs.columns.index(text_col)
    ready = _scorer(model, docs.sparkSession)

    def run(batches):
        own, restorer, table = ready()
        for batch in batches:
            s = own.scores(batch.column(place).cast(pa.string()), restorer, table)
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
