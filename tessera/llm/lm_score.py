"""Language-model scores by online logistic context mixing.

A text is its words (A-Z lower-cased, between ASCII white space) and one end
token.  Its probability is built from binary decisions, each predicted by
several hashed-context bit predictors that a gated logistic mixer combines:

* *repeat?* - does the token repeat one that the text has had already?  Three
  predictors (contexts: the previous word, the last three outcomes, the
  position) keep a probability for every context and learn while the text is
  read; the mixer's weight set is picked by the position and learns as well.  A
  repeat has the probability of its share among the tokens so far, any other
  token its share in the training corpus, and the two are added up.
* *code* - a word that training knows is coded by 8 bits of its hash, each mixed
  from three predictors: the text's class, the previous word, the previous two
  (``word_bits``).  Its share among the class's words of one code gives the rest.
* *spelling* - a word that training never saw is spelled bit by bit.  Hashed
  contexts of the 1 to 4 preceding bytes of the word predict every bit; the
  mixer's weight set is picked by the longest context known.  Tables are counts
  over all distinct training words, weights were learned online.

Shares are those of the text's class (one of ``CLASSES`` groups of similar
texts, found from byte pairs; naming it costs its own probability), backed by
the whole corpus.  A score is the total as log10; minus its log2 is the number
of bits, from which bits per byte follow.

Counts of words cover every training text and grow with them, so they are never
sent to one place: texts are read in packs of ``PACK`` bytes, a pack asks the
hash buckets of the vocabulary for its distinct words, and answers and text meet
again in one task.  Only the class centres, the tables of spelling and of codes
and a few totals are broadcast (fixed sizes, about 60 MB).  The class centres come
from all training texts: each task groups its own, the groups' weighted centres are
grouped again, and a round over the whole corpus makes them the means of their texts.
The mixer's start weights are learned in every bucket of the vocabulary from all its
words and averaged; those of codes in every task from all its training texts.  What
tasks add up meets in groups of tasks first, so no task reads a row of every other.

Cases: a null or empty text is the end token alone; repeated rows count each; a
null id counts as the empty text for folds; without training texts every word is
unknown; an empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import settle
from . import kernel as K
from . import word_bits
from .packed import by_bucket, dealt, pack, rows, unpack, ROW

CLASSES = 8
PACK = 4 << 20
ORDERS = 4
SLOTS = 1 << 18
SMOOTH = 0.1
END = np.uint64(0x656E64)  # the end token's hash: no word has it but by chance

_NOT_SPACE = ~K.SPACE

# --- classes of texts ------------------------------------------------------

_LETTER = np.zeros(256, np.int32)
_LETTER[97:123] = np.arange(1, 27)
_LETTER[65:91] = np.arange(1, 27)
_LETTER[48:58] = 27
_LETTER[128:] = 28 + np.arange(128) % 36
_DIMS = 64 * 64


_TEXTS = 64  # texts whose byte pairs are counted at once
_GROUP = 512  # texts that are grouped at once, at most


def _pair_roots(data: np.ndarray, offs: np.ndarray):
    """(first, last, square roots of the byte-pair counts of each text between)."""
    c = _LETTER[data]
    pair = c[:-1] * 64 + c[1:]
    n = len(offs) - 1
    for i in range(0, n, _TEXTS):
        j = min(i + _TEXTS, n)
        a, b = int(offs[i]), max(int(offs[j]) - 1, int(offs[i]))
        size = np.diff(offs[i : j + 1])
        row = np.arange(j - i, dtype=np.int32) * _DIMS
        counts = np.bincount(pair[a:b] + np.repeat(row, size)[: b - a], minlength=(j - i) * _DIMS)
        end = offs[i + 1 : j + 1] - 1
        across = (size > 0) & (end < b)  # a text's last byte and the next text's first are no pair
        counts[pair[end[across]] + row[across]] -= 1
        yield i, j, np.sqrt(counts.astype(np.float32)).reshape(j - i, _DIMS)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x**2).sum(1, keepdims=True)), 1e-9)


def _profile(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Unit vectors of the square roots of byte-pair shares, one a text."""
    return np.concatenate([np.zeros((0, _DIMS), np.float32), *(_unit(x) for _, _, x in _pair_roots(data, offs))])


def _centres(x: np.ndarray, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Spherical k-means from farthest-first starts."""
    if not len(x):
        return np.zeros((1, _DIMS), np.float32)
    w = np.ones(len(x), np.float32) if weight is None else weight.astype(np.float32)
    picked = [int(np.argmax(x @ (w @ x)))]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin((x @ x[picked].T).max(1))))
    centre, before = x[picked], None
    for _ in range(12):
        own = np.argmax(x @ centre.T, 1)
        if before is not None and (own == before).all():
            break
        new = np.stack([w[own == j] @ x[own == j] if (own == j).any() else centre[j] for j in range(len(centre))])
        centre, before = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-9), own
    return centre.astype(np.float32)


def _grouped(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The centres of all groups, grouped again, and how many texts each stands for."""
    x, w = (np.concatenate(p) for p in zip(*sorted(parts, key=lambda p: p[0].tobytes())))
    centre = _centres(x, CLASSES, w)
    return centre, np.bincount(np.argmax(x @ centre.T, 1), w, len(centre))


# --- tokens ----------------------------------------------------------------


class Words:
    """Tokens of a run of texts: hash of each, token offsets, and where each
    word's bytes are (the end token has none)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        starts, ends, woff = K.word_spans(data, offs, _NOT_SPACE)
        n = len(offs) - 1
        self.off = woff + np.arange(n + 1)
        total = len(starts) + n
        word = np.ones(total, bool)
        word[self.off[1:] - 1] = False
        self.hash = np.full(total, END, np.uint64)
        self.hash[word] = K.word_hashes(data, starts, ends)
        self.start = np.zeros(total, np.int64)
        self.end = np.zeros(total, np.int64)
        self.start[word], self.end[word] = starts, ends
        self.data = K.LOWER[data]
        self.doc = np.repeat(np.arange(n), np.diff(self.off))
        self.place = np.arange(total) - self.off[self.doc]

    def texts(self, tokens: np.ndarray) -> list[bytes]:
        raw = self.data.tobytes()
        return [raw[a:b] for a, b in zip(self.start[tokens].tolist(), self.end[tokens].tolist())]


def _distinct(words: Words, cls: np.ndarray):
    """Distinct (class, hash) of the tokens: a token of each, and each token's number."""
    key = words.hash * np.uint64(64) + cls[words.doc].astype(np.uint64)
    _, first, number = np.unique(key, return_index=True, return_inverse=True)
    return first, number.reshape(-1)


# --- spelling --------------------------------------------------------------


def _bits(words: list[bytes]):
    """For every bit of the words, each ended by a blank: its slot in the table
    of each order, its value and its word."""
    data = np.frombuffer(b" ".join(words) + b" " if words else b"", np.uint8)
    size = np.array([len(w) + 1 for w in words], np.int64)
    first = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(len(data))
    byte = data.astype(np.uint64)
    context = np.zeros(len(data), np.uint64)
    slots = np.empty((ORDERS, len(data), 8), np.int32)
    node = np.ones((len(data), 8), np.uint64)
    for b in range(1, 8):
        node[:, b] = node[:, b - 1] * np.uint64(2) + ((byte >> np.uint64(8 - b)) & np.uint64(1))
    for order in range(1, ORDERS + 1):
        before = at - order
        context = context * np.uint64(0x100000001B3) + np.where(before >= first, byte[np.maximum(before, 0)] + np.uint64(1), np.uint64(0))
        h = K.mix((context * np.uint64(257) + np.uint64(order))[:, None] * np.uint64(0x9E3779B97F4A7C15) + node)
        slots[order - 1] = (h >> np.uint64(46)).astype(np.int32)
    value = ((data[:, None] >> (7 - np.arange(8))) & 1).astype(np.int8)
    return slots.reshape(ORDERS, -1), value.reshape(-1), np.repeat(np.arange(len(words)), size * 8)


_SPELLED = 500  # words whose bits are laid out at once


def _spelling_counts(words: list[bytes]) -> np.ndarray:
    """Table [order, bit, slot] of the bits of the words."""
    out = np.zeros((ORDERS, 2, SLOTS), np.int32)
    flat = out.reshape(ORDERS, -1)
    for i in range(0, len(words), 10000):
        held = []
        for j in range(i, min(i + 10000, len(words)), _SPELLED):  # small arrays, counted together
            slots, value, _ = _bits(words[j : min(j + _SPELLED, i + 10000)])
            held.append(slots + value * np.int32(SLOTS))
        for order, slots in enumerate(np.concatenate(held, 1)):
            flat[order] += np.bincount(slots, minlength=2 * SLOTS).astype(np.int32)
    return out


def _stretch(p):
    return np.log(p / (1 - p))


def _squash(x):
    return 1 / (1 + np.exp(-x))


class Speller:
    """Mixes the bit predictors of the spelling contexts."""

    def __init__(self, counts: np.ndarray, weights: np.ndarray | None = None):
        n = counts.sum(1)
        self.gate = (n > 0) * np.arange(1, ORDERS + 1, dtype=np.uint8)[:, None]
        self.input = _stretch((counts[:, 1] + 0.4) / (n + 0.8)).astype(np.float32)
        # a context's vote counts for more the more it has seen
        self.input *= np.minimum(1, 0.35 + 0.1 * np.log1p(n)).astype(np.float32)
        self.weights = np.full((ORDERS + 1, ORDERS), 0.4) if weights is None else weights

    def copy(self) -> Speller:
        """The same tables with weights of its own."""
        other = object.__new__(Speller)
        other.gate, other.input, other.weights = self.gate, self.input, self.weights.copy()
        return other

    def _inputs(self, slots):
        x = [self.input[o].take(slots[o]) for o in range(ORDERS)]
        gate = self.gate[0].take(slots[0])
        for o in range(1, ORDERS):
            np.maximum(gate, self.gate[o].take(slots[o]), out=gate)
        sums = sum(v * w.take(gate) for v, w in zip(x, np.ascontiguousarray(self.weights.T)))
        return x, gate, sums

    def learn(self, words: list[bytes], rate: float = 0.02, passes: int = 2) -> None:
        """Online: the weights move after every 100 words."""
        for _ in range(passes):
            for i in range(0, len(words), _SPELLED):
                all_slots, values, word = _bits(words[i : i + _SPELLED])
                edge = np.searchsorted(word, np.arange(0, word[-1] + 101, 100))
                for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                    slots, value = all_slots[:, a:b], values[a:b]
                    x, gate, sums = self._inputs(slots)
                    error = value - _squash(sums)
                    n = np.sqrt(np.maximum(np.bincount(gate, minlength=ORDERS + 1), 1))
                    for o, v in enumerate(x):
                        self.weights[:, o] += rate * np.bincount(gate, error * v, ORDERS + 1) / n

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability."""
        out = np.zeros(len(words))
        far = np.log(1e5 - 1)  # a bit's probability is 1e-5 at least
        for i in range(0, len(words), 500):
            slots, value, word = _bits(words[i : i + 500])
            sums = np.clip(self._inputs(slots)[2], -far, far)
            cost = 1 + np.exp(np.where(value == 1, -sums, sums))
            out[i : i + 500] = -np.bincount(word[::8], np.log10(cost.reshape(-1, 8).prod(1)), len(words[i : i + 500]))
        return out


# --- repeats: the adaptive mixer ------------------------------------------

_STEP = 8
_PREVIOUS, _OUTCOMES, _PLACES = 64, 8, 16
_START = np.array([0.5, 0.5, 0.5])


def _mixed(words: Words, number: np.ndarray, log_new: np.ndarray) -> np.ndarray:
    """log10 of each token's probability: repeats mixed with new tokens.  Tokens of
    one text are the same where their numbers are.

    Texts advance together, _STEP tokens at a time; predictors and weights of a
    text move after each step."""
    n_docs = len(words.off) - 1
    size = np.diff(words.off)
    n = len(number)
    bits = np.uint64(max(n.bit_length(), 1))  # a number and a token's place in one sortable word
    key = np.sort((number.astype(np.uint64) << bits) | np.arange(n, dtype=np.uint64))
    order = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    key >>= bits
    owner = words.doc[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]
    times = np.empty(n, np.int64)
    times[order] = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
    del key, order, owner, new
    place = words.place
    cached = times / np.maximum(place, 1)
    fresh = log_new * np.log(10)  # in logarithms: a long unknown word's probability has no floor
    hit = (times > 0).astype(np.uint8)
    del times
    # a text's predictors are one row: by the previous word, the outcomes, the position
    width = _PREVIOUS + _OUTCOMES + _PLACES
    contexts = np.zeros((n, 3), np.uint8)
    contexts[1:, 0] = words.hash[:-1] >> np.uint64(58)
    contexts[:, 1] = _PREVIOUS
    for back in (1, 2, 3):
        contexts[back:, 1] += np.where(place[back:] >= back, hit[:-back], np.uint8(0)) << np.uint8(back - 1)
    bucket = np.minimum(np.log2(place + 1), _PLACES - 1).astype(np.uint8)
    contexts[:, 2] = bucket + np.uint8(_PREVIOUS + _OUTCOMES)
    out = np.zeros(n)
    by = np.argsort(-size, kind="stable")
    offset, length = words.off[:-1][by], size[by]
    table, seen = np.full(n_docs * width, 0.2), np.full(n_docs * width, 1.5)
    weights = np.tile(_START, (n_docs, _PLACES, 1))
    step = np.arange(_STEP)
    for t in range(0, int(length.max(initial=0)), _STEP):
        live = int(np.searchsorted(-length, -t, "left"))  # texts longer than t
        index = offset[:live, None] + t + step
        inside = t + step < length[:live, None]
        index = np.where(inside, index, offset[:live, None])
        doc = np.arange(live)
        at = contexts[index] + doc[:, None, None] * width
        stretched = _stretch(table[at])
        gate = bucket[index[:, 0]]
        w = weights[doc, gate]
        rate = np.clip(_squash((stretched * w[:, None]).sum(2)), 1e-4, 1 - 1e-4)
        with np.errstate(divide="ignore"):
            old = np.log(rate * cached[index])
        total = np.logaddexp(old, np.log1p(-rate) + fresh[index])
        share = np.exp(old - total)  # how much the repeat explains
        error = np.where(inside, share - rate, 0)
        weights[doc, gate] = w + 0.02 * (error[:, :, None] * stretched).sum(1)
        out[index[inside]] = total[inside] / np.log(10)
        at, share = at[inside], share[inside][:, None]
        np.add.at(seen, at.reshape(-1), 1.0)
        moved = (share - table[at]) / np.minimum(seen[at], 60)
        np.add.at(table, at.reshape(-1), moved.reshape(-1))
        table[at] = np.clip(table[at], 0.002, 0.998)
    return out


# --- the model -------------------------------------------------------------


@dataclass
class Model:
    centres: np.ndarray
    tokens: np.ndarray  # training tokens of each class
    texts: np.ndarray  # training texts of each class
    types: int  # distinct training tokens
    speller: Speller | None = None
    codes: word_bits.CodeMixer | None = None
    code_tokens: np.ndarray | None = None  # training tokens of each class and code
    code_kinds: np.ndarray | None = None  # and the distinct ones
    kinds: np.ndarray | None = None  # distinct tokens of each class
    once: int = 0  # distinct tokens that occur once, and twice
    twice: int = 0
    single: int = 0  # (class, token) pairs that occur once

    def strange(self) -> float:
        """Of tokens new to their class, the share new to the corpus."""
        return min(0.95, max(0.05, self.once / self.single)) if self.single else 0.95

    def discount(self) -> float:
        """Absolute discount: the share of a count that new words get."""
        return self.once / (self.once + 2 * self.twice) if self.once and self.twice else 0.75

    def code_share(self) -> np.ndarray:
        """Of each class's known words, the share of every code."""
        n = np.maximum(self.tokens, 1)[:, None]
        left = np.where(self.tokens > 0, self.discount() * self.kinds / n[:, 0], 1.0)[:, None] * (1 - self.strange())
        return (self.code_tokens - self.discount() * self.code_kinds) / n + left * self.code_tokens.sum(0) / max(self.tokens.sum(), 1)

    def classify(self, data, offs) -> np.ndarray:
        out = np.zeros(len(offs) - 1, np.int64)
        for i, j, x in _pair_roots(data, offs):
            out[i:j] = np.argmax(x @ self.centres.T, 1)  # a vector's length changes no order
        return out


def _classes(texts: DataFrame) -> np.ndarray:
    """Class centres from all training texts: those of parts of a task are grouped
    again by task, by group of tasks and at last over all."""
    fan = _fan(texts.sparkSession)

    def run(batches):
        parts = []
        for batch in batches:
            data, offs = K.text_bytes(batch.column(0))
            for first, last in K.chunks(offs):
                for i in range(first, last, _GROUP):
                    j = min(i + _GROUP, last)
                    x = _profile(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                    parts.append(_grouped([(x, np.ones(len(x)))]))
        if parts:
            yield rows([(TaskContext.get().partitionId() % fan, COUNTS, pack(_grouped(parts)))])

    def meet(batches):
        if parts := [unpack(raw) for batch in batches for raw in batch.column(2).to_pylist()]:
            yield rows([(0, COUNTS, pack(_grouped(parts)))])

    got = by_bucket(texts.select("t").mapInArrow(run, ROW), fan).mapInArrow(meet, ROW).collect()  # a row a group
    return _grouped([unpack(r["payload"]) for r in got])[0] if got else _centres(np.zeros((0, _DIMS), np.float32), CLASSES)


def _refined(texts: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The means of the classes of all training texts."""
    start = texts.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        sums = np.zeros(start.value.shape)
        for batch in batches:
            data, offs = K.text_bytes(batch.column(0))
            for i, j in K.chunks(offs):
                for _, _, x in _pair_roots(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]):
                    x = _unit(x)
                    own = np.argmax(x @ start.value.T, 1)
                    for k in np.unique(own):
                        sums[k] += x[own == k].sum(0)
        if sums.any():
            yield rows([(int(k), COUNTS, pack(sums[k])) for k in np.flatnonzero(sums.any(1))])

    out = centres.copy()
    for row in _combined(texts.select("t").mapInArrow(run, ROW), len(centres)).collect():  # a vector for each class
        mean = unpack(row["payload"])
        out[row["bucket"]] = mean / max(np.linalg.norm(mean), 1e-9)
    return out


COUNTS, ASKED, ANSWERED, TEXT, WORDS, CONTEXTS = range(6)
#: Buckets of the vocabulary's tables: totals, tables to add up (of spelling, of
#: hashed contexts, of codes), words to learn from.
_TOTALS, _TABLES, _LEARN = -1, -2, -1000
_SPELLING, _CODES = ORDERS * 2, ORDERS * 2 + word_bits.CONTEXTS


def _planes(table: np.ndarray) -> bytes:
    """Counts by byte planes: those of small numbers pack to little."""
    return pack(np.ascontiguousarray(table.astype("<i8").view(np.uint8).reshape(-1, 8).T))


def _counts(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view("<i8").reshape(-1)


def _fan(spark) -> int:
    """Groups of tasks whose tables are added up first."""
    return max(1, round(int(spark.conf.get("spark.sql.shuffle.partitions")) ** 0.5))


def _count_words(model, buckets: int, fan: int):
    def run(batches):
        around = word_bits.no_counts()
        for batch in batches:
            data, offs = K.text_bytes(batch.column(0))
            for i, j in K.chunks(offs, PACK):
                part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                cls = model.value.classify(part, own)
                words = Words(part, own)
                word_bits.add_counts(around, words.hash, words.place)
                first, number = _distinct(words, cls)
                n = np.bincount(number)
                h, c = words.hash[first], cls[words.doc[first]]
                text = np.array(words.texts(first), object)
                yield rows([(b, COUNTS, pack((h[x], c[x].astype(np.uint8), n[x], text[x].tolist()))) for b, x in dealt(h, buckets)])
        if around.any():
            group = TaskContext.get().partitionId() % fan
            yield rows([((group * word_bits.CONTEXTS + o) % buckets, CONTEXTS, pack((o, _planes(t)))) for o, t in enumerate(around)])

    return run


def _summed(parts):
    """Counts by (hash, class) of packed counts, sorted, and each hash's word."""
    h = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts])
    n = np.concatenate([p[2] for p in parts])
    order = np.lexsort((c, h))
    h, c, n = h[order], c[order], n[order]
    edge = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])])
    return h[edge], c[edge], np.add.reduceat(n, edge), order[edge]


def _vocabulary(classes: int):
    """Each bucket's summed counts, and its share of the totals and spelling tables."""

    def run(batches):
        held: dict[int, list] = {}
        around: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, kind, raw in zip(*(x.to_pylist() for x in batch.columns)):
                if kind == CONTEXTS:
                    o, planes = unpack(raw)
                    around[o] = around.get(o, 0) + _counts(unpack(planes))
                else:
                    held.setdefault(b, []).append(raw)
        for o in list(around):
            yield rows([(_TABLES - _SPELLING - o, COUNTS, _planes(around.pop(o)))])
        codes = np.zeros((2, classes * word_bits.CODES), np.int64)
        tokens, kinds, types, often = np.zeros(classes, np.int64), np.zeros(classes, np.int64), 0, np.zeros(3, np.int64)
        ends = np.zeros(classes, np.int64)
        table, some = np.zeros((ORDERS, 2, SLOTS), np.int32), []
        for b in list(held):
            parts = [unpack(r) for r in held.pop(b)]
            h, c, n, at = _summed(parts)
            texts = [w for p in parts for w in p[3]]
            new = np.r_[True, h[1:] != h[:-1]]
            tokens += np.bincount(c, n, classes).astype(np.int64)
            kinds += np.bincount(c, minlength=classes)
            ends += np.bincount(c[h == END], n[h == END], classes).astype(np.int64)
            types += int(new.sum())
            at_code = c.astype(np.int64) * word_bits.CODES + word_bits.code(h)
            codes += [np.bincount(at_code, n, codes.shape[1]).astype(np.int64), np.bincount(at_code, minlength=codes.shape[1])]
            all_n = np.add.reduceat(n, np.flatnonzero(new))
            often += [int((all_n == 1).sum()), int((all_n == 2).sum()), int((n == 1).sum())]
            words = [texts[i] for i in at[new]]
            table += _spelling_counts([w for w in words if w])
            some += [w for w in words if w]
            yield rows([(b, COUNTS, pack((h, c, n)))])
        if types:
            yield rows([(_TOTALS, COUNTS, pack((tokens, ends, kinds, types, often)))])
            for i in range(ORDERS * 2):
                yield rows([(_TABLES - i, COUNTS, pack(table[i // 2, i % 2]))])
            yield rows([(_TABLES - _CODES - i, COUNTS, _planes(x)) for i, x in enumerate(codes)])
            if some:
                yield rows([(_LEARN, WORDS, pack(some))])

    return run


def _add_tables(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, _, raw in zip(*(x.to_pylist() for x in batch.columns)):
            table = unpack(raw)
            if table.dtype.kind == "u":
                table = _counts(table)
            sums[b] = sums.get(b, 0) + (table.astype(np.int64) if table.dtype.kind == "i" else table)
    if sums:
        yield rows([(b, COUNTS, _planes(v) if v.dtype.kind == "i" else pack(v)) for b, v in sums.items()])


def _combined(tables: DataFrame, keys: int) -> DataFrame:
    """The sums of the packed arrays of each of ``keys`` buckets: groups of tasks are
    added up first, then the groups."""
    fan = _fan(tables.sparkSession)
    salted = tables.withColumn("__salt", F.spark_partition_id() % fan).repartition(keys * fan, "bucket", "__salt").drop("__salt")
    return salted.mapInArrow(_add_tables, ROW).repartition(keys, "bucket").mapInArrow(_add_tables, ROW)


def _learned(speller):
    """The weights that a row's words teach, times their number, and that number."""

    def run(batches):
        for batch in batches:
            for raw in batch.column(2).to_pylist():
                words = unpack(raw)
                own = speller.value.copy()
                own.learn(words, passes=1)
                yield rows([(0, COUNTS, pack(np.r_[own.weights.ravel() * len(words), float(len(words))]))])

    return run


def _learned_codes(model):
    """The code weights that a task's texts teach, times their uses, and the uses."""

    def run(batches):
        mixer = model.value.codes.learner()
        used = np.zeros(mixer.weights.shape[:2])
        for batch in batches:
            data, offs = K.text_bytes(batch.column(0))
            for i, j in K.chunks(offs):
                part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                cls = model.value.classify(part, own)
                words = Words(part, own)
                mixer.learn(words.hash, words.place, cls[words.doc], used)
        if used.any():
            yield rows([(0, COUNTS, pack(np.concatenate([mixer.weights * used[:, :, None], used[:, :, None]], 2)))])

    return run


def _ask(model, buckets: int):
    """Packs of texts, and the questions for the counts of their words."""

    def run(batches):
        for batch in batches:
            data, offs = K.text_bytes(batch.column(1))
            for i, j in K.chunks(offs, PACK):
                part, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                ids = batch.column(0).slice(i, j - i)
                cls = model.value.classify(part, own).astype(np.uint8)
                words = Words(part, own)
                first, _ = _distinct(words, cls)
                h, c = words.hash[first], cls[words.doc[first]]
                raw = pack((ids.to_pylist(), batch.column(2).slice(i, j - i).to_pylist(), np.diff(own), cls, part.tobytes()))
                home = zlib.crc32(raw) >> 1
                out = [(b, ASKED, pack((home, h[x], c[x]))) for b, x in dealt(h, buckets)]
                yield rows([*out, (home, TEXT, raw)])

    return run


def _answer(batches):
    known: dict[int, tuple] = {}
    for batch in batches:
        out = []
        for b, kind, raw in zip(*(x.to_pylist() for x in batch.columns)):
            if kind == COUNTS:
                known[b] = unpack(raw)
            elif kind == TEXT:
                out.append((b, kind, raw))
            else:
                home, h, c = unpack(raw)
                if b in known:
                    vh, vc, vn = known[b]
                    low, high = np.searchsorted(vh, h, "left"), np.searchsorted(vh, h, "right")
                    run_sum = np.r_[0, np.cumsum(vn)]
                    total = run_sum[high] - run_sum[low]
                    own = np.zeros(len(h), np.int64)
                    for step in range(int((high - low).max(initial=0))):
                        at = low + step
                        yes = (at < high) & (vc[np.minimum(at, len(vc) - 1)] == c)
                        own[yes] = vn[at[yes]]
                else:
                    total = own = np.zeros(len(h), np.int64)
                out.append((home, ANSWERED, pack((h, c, total, own))))
        if out:
            yield rows(out)


def _score(model, id_type, names):
    def run(batches):
        answers: dict[int, list] = {}
        for batch in batches:
            for home, kind, raw in zip(*(x.to_pylist() for x in batch.columns)):
                if kind == ANSWERED:
                    answers.setdefault(home, []).append(raw)
                else:
                    yield one(unpack(raw), [unpack(a) for a in answers.get(home, [])])

    def one(pack_, answers):
        m = model.value
        ids, held, sizes, cls, data = pack_
        data = np.frombuffer(data, np.uint8)
        offs = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        words = Words(data, offs)
        first, number = _distinct(words, cls)
        key = words.hash[first] * np.uint64(64) + cls[words.doc[first]].astype(np.uint64)
        ah, ac, at_, ao = (np.concatenate(x) for x in zip(*answers))
        akey = ah * np.uint64(64) + ac.astype(np.uint64)
        order = np.argsort(akey, kind="stable")
        where = order[np.searchsorted(akey[order], key)]
        c, own = at_[where].astype(float), ao[where].astype(float)
        n_all = float(m.tokens.sum())
        base = np.log10((c + SMOOTH) / (n_all + SMOOTH * (m.types + 1)))
        # discounted shares of the class; what is left goes to the corpus and to spelling
        k = cls[words.doc[first]]
        d = m.discount()
        n_own = np.maximum(m.tokens[k], 1)
        left = np.where(m.tokens[k] > 0, d * m.kinds[k] / n_own, 1.0)
        new = m.strange()
        fresh = np.maximum(own - d, 0) / n_own + left * (1 - new) * c / max(n_all, 1.0)
        strange = np.flatnonzero(c == 0)
        spelled = words.texts(first[strange])
        fresh[strange] = left[strange] * new
        fresh = np.log10(fresh)
        fresh[strange] += m.speller.log10(spelled)
        # a known word: the class's mass of known words, its code, its share among the words of that code
        share = m.code_share()
        mass = 1 - left * new
        old = c > 0
        with np.errstate(divide="ignore"):
            fresh[old] += np.log10(mass[old] / share[k[old], word_bits.code(words.hash[first][old])])
        fresh = fresh[number]
        at = np.flatnonzero(old[number])
        fresh[at] += m.codes.log10(words.hash, words.place, cls[words.doc].astype(np.int64))[at]
        token = _mixed(words, number, fresh)
        n_docs = len(ids)
        prior = np.log10((m.texts[cls] + 1.0) / (m.texts.sum() + len(m.texts)))
        score = np.bincount(words.doc, token, n_docs) + prior
        base_score = np.bincount(words.doc, base[number], n_docs)
        known = np.bincount(words.doc, (c > 0)[number], n_docs).astype(np.int64)
        columns = [
            pa.array(ids, id_type), pa.array(held), pa.array(np.diff(words.off)), pa.array(known), pa.array(np.full(n_docs, int(n_all))),
            pa.array(base_score), pa.array(score), pa.array(-score / np.log10(2) / np.maximum(sizes, 1)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    return run


def scores(docs: DataFrame, held_out, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens,
    base_score (smoothed unigrams), score (log10 of the model's probability) and
    bits_per_byte.  ``held_out`` is a condition; the other texts are learned from."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = parts
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"), F.coalesce(held_out, F.lit(False)).alias("held"))
    train = texts.where(~F.col("held"))
    centres = _refined(train, _classes(train))
    start = spark.sparkContext.broadcast(Model(centres, np.zeros(len(centres)), np.zeros(len(centres)), 0))
    counted = train.select("t").mapInArrow(_count_words(start, buckets, _fan(spark)), ROW)
    vocabulary = settle(by_bucket(counted, parts).mapInArrow(_vocabulary(len(centres)), ROW), "lm-vocabulary")

    nothing = np.zeros(len(centres), np.int64)
    model = Model(centres, nothing, nothing, 0, kinds=nothing)
    for row in vocabulary.where(F.col("bucket") == _TOTALS).toLocalIterator():  # a few numbers a task
        tokens, ends, kinds, types, often = unpack(row["payload"])
        model.tokens = model.tokens + tokens
        model.texts = model.texts + ends
        model.kinds = model.kinds + kinds
        model.types += types
        model.once += int(often[0])
        model.twice += int(often[1])
        model.single += int(often[2])
    table = np.zeros((ORDERS, 2, SLOTS), np.int64)
    around = word_bits.no_counts()
    codes = np.zeros((2, len(centres) * word_bits.CODES), np.int64)
    tables = vocabulary.where((F.col("bucket") <= _TABLES) & (F.col("bucket") > _LEARN))
    for row in _combined(tables, _CODES + 2).collect():  # as many tables of fixed sizes
        i, counts = _TABLES - row["bucket"], _counts(unpack(row["payload"]))
        if i < _SPELLING:
            table[i // 2, i % 2] += counts
        elif i < _CODES:
            around[i - _SPELLING] += counts
        else:
            codes[i - _CODES] += counts
    model.code_tokens, model.code_kinds = codes.reshape(2, len(centres), word_bits.CODES)
    model.codes = word_bits.CodeMixer(word_bits.class_rows(model.code_tokens), around)
    weights = model.codes.weights.copy()
    learning = spark.sparkContext.broadcast(model)
    for row in _combined(train.select("t").mapInArrow(_learned_codes(learning), ROW), 1).collect():  # one row
        sums = unpack(row["payload"])
        moved = sums[:, :, -1] > 0
        weights[moved] = sums[moved][:, :-1] / sums[moved][:, -1:]
    model.codes.ready(weights)
    model.speller = Speller(table)
    speller = spark.sparkContext.broadcast(model.speller)
    taught = vocabulary.where(F.col("bucket") == _LEARN).mapInArrow(_learned(speller), ROW)
    for row in _combined(taught, 1).collect():  # one row
        sums = unpack(row["payload"])
        model.speller = model.speller.copy()
        model.speller.weights = (sums[:-1] / sums[-1]).reshape(ORDERS + 1, ORDERS)
    held = spark.sparkContext.broadcast(model)

    asked = texts.select("id", "t", "held").mapInArrow(_ask(held, buckets), ROW)
    met = by_bucket(vocabulary.where("bucket >= 0").unionByName(asked), parts).sortWithinPartitions("kind")
    answered = met.mapInArrow(_answer, ROW)
    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"]
    kinds = [texts.schema["id"].dataType, T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.DoubleType()]
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds)])
    home = by_bucket(answered, parts).sortWithinPartitions("kind")
    return home.mapInArrow(_score(held, to_arrow_type(kinds[0]), names), schema)

