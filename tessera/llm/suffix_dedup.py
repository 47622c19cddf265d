"""Removal of repeated byte strings by a hash-compared suffix sort.

A byte is removed when a string of ``LENGTH`` bytes covers it that also starts
earlier: in a document with a smaller id, or in the same document before.
Strings are judged on the input.  Matches never cross documents.

Every window of LENGTH bytes picks an anchor: of its ``GRAM``-byte strings the
one with the smallest hash, the leftmost of equals.  Equal windows pick anchors
at equal offsets, so equal windows meet where their anchors meet:

1. *Anchors* (about 2 of LENGTH - GRAM bytes) go to buckets by their hash; a
   task sends the first of those it has several times.  Anchors that occur in two
   places are sent to their documents.  Copies of a text count as one place: a
   text's home is its digest's, where the copy with the smallest id stands for
   all and the others are removed whole.  Wherever texts of one digest meet, their
   bytes are compared; different texts are documents each.
2. *Fragments*: a document sends, for each repeated anchor, the bytes of the
   windows that pick it.  Equal fragments of a task are sent once.  An anchor that
   very many texts share (``HOT``) would bring them all to one task, so its windows
   are dealt in bands of their distance from it, each band by the bytes that all its
   windows hold: equal windows still meet.  Which anchors are hot is counted in one
   of ``HOT_SHARE`` texts; it moves work between tasks and changes no result.
3. *Suffix sort*: in a bucket the suffixes that start a window are sorted, those
   of one anchor and distance from it together, by a bottom-up mergesort.  Two suffixes are compared through the
   length of their common prefix, found by binary search over prefix polynomial
   hashes (7 steps for 100 bytes), then by the next byte.  Neighbours that agree
   in LENGTH bytes are equal windows; their bytes are compared, and should a
   hash have collided, the anchor's suffixes are sorted by their bytes.  Of
   equal windows the first stays, the others are reported to their documents.
   Windows whose hash no other has are left out, and a bucket is sorted in slices
   of anchors and distances, so temporary arrays don't grow with it.
4. *Documents* unite the reported windows.

It is one plan of four exchanges after the count of hot anchors; what moves are packed arrays, dealt by hash
buckets.  An anchor's rows are combined in every task before each exchange, so a
string held by a third of all documents arrives once a task.

Cases: a null text is empty and keeps the hash of no bytes; a text shorter than
LENGTH keeps all; a null id counts as larger than any other; of rows that repeat
an id none is earlier than another, and each is judged by itself; an empty table
gives an empty result; further columns are left alone.  Ids are integers.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .packed import ROW as _ROW
from .packed import by_bucket, dealt
from .packed import pack as _pack
from .packed import rows as _rows
from .packed import unpack as _unpack

LENGTH = 100
GRAM = 24
#: Bytes of text whose fragments a task gathers before it sends them.
GATHER = 48 << 20
_NULL = np.iinfo(np.int64).max
_NONE = np.zeros(0, np.uint64)
#: Windows that are looked at, and bytes of fragments that are compared, at once.
WINDOWS, SLICE = 1 << 20, 2 << 20
#: Occurrences from which an anchor is hot, the share of texts in which they are
#: counted, and how many distances from it make a band.
HOT, HOT_SHARE, BAND = 32_000, 16, 10
#: Kinds of packed rows, in the order in which a task reads them.
REPEATED, FRAGMENTS, REMOVED, COPIES, TEXTS = range(5)


# --- anchors ---------------------------------------------------------------


def anchors(data: np.ndarray, offs: np.ndarray, length: int, gram: int):
    """Position and hash of each anchor, and the first and last window start
    that picks it."""
    n = len(data)
    none = np.zeros(0, np.int64)
    counts = np.maximum(np.diff(offs) - length + 1, 0)
    if not counts.sum():
        return none, none.astype(np.uint64), none, none
    prefix = K.prefix_hash(data)
    at = np.arange(n - gram + 1)
    h = K.mix(K.span_hash(prefix, at, at + gram))
    bits = np.uint64(max(24, int(n).bit_length()))
    key = (h >> bits << bits) | at.astype(np.uint64)
    w, least, have = length - gram + 1, key, 1
    while have * 2 <= w:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < w:
        least = np.minimum(least[: len(key) - w + 1], least[w - have : w - have + len(key) - w + 1])
    starts = np.repeat(offs[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    pick = (least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, pick[1:] != pick[:-1]])
    last = np.r_[edge[1:], len(pick)] - 1
    return pick[edge], h[pick[edge]], starts[edge], starts[last]


def _ids(column) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(_NULL).to_numpy(zero_copy_only=False).astype(np.int64)


def _digests(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    raw = b"".join(hashlib.blake2b(data[a:z], digest_size=8).digest() for a, z in zip(offs[:-1], offs[1:]))
    return np.frombuffer(raw, np.int64)


def _distinct(data: np.ndarray, offs: np.ndarray, ids: np.ndarray, length: int):
    """Of a batch's equal texts the first by id: their places and digests, how
    often the same id repeats the text, and the places of the other copies.
    Texts shorter than ``length`` are all first ones, and so are texts that only
    share a digest with another."""
    digest, size = _digests(data, offs), np.diff(offs)
    order = np.lexsort((ids, digest))
    new = np.r_[True, digest[order][1:] != digest[order][:-1]] if len(order) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    equal = _same_bytes(data, offs[:-1][order], size[order], group)
    same = equal & (ids[order] == ids[order][head][group]) if len(order) else new
    times = np.bincount(group[same], minlength=len(head))
    copy = equal & ~same & (size[order] >= length)
    alone = ~same & ~copy
    first = np.r_[order[head], order[alone]]
    return first, digest[first], np.r_[times, np.ones(int(alone.sum()), np.int64)], order[copy]


def _send_anchors(length: int, gram: int, buckets: int):
    def run(batches):
        for batch in batches:
            ids = _ids(batch.column(0))
            data, offs = K.text_bytes(batch.column(1))
            places, digests, _, _ = _distinct(data, offs, ids, length)
            digest = np.zeros(len(ids), np.int64)
            digest[places] = digests
            first_of = np.zeros(len(ids), bool)
            first_of[places] = True
            parts = []
            for i, j in K.chunks(offs):
                own = offs[i : j + 1] - offs[i]
                pos, h, _, _ = anchors(data[offs[i] : offs[j]], own, length, gram)
                doc = np.searchsorted(own, pos, "right") - 1
                yes = first_of[i + doc]
                parts.append((h[yes], digest[i + doc[yes]], (pos - own[doc])[yes]))
            if not parts:
                continue
            h, doc, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(h, kind="stable")
            h, doc, pos = h[order], doc[order], pos[order]
            first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
            edge = np.flatnonzero(first)
            again = np.diff(np.r_[edge, len(h)]) > 1
            out = [(b, FRAGMENTS, _pack((h[edge[x]], doc[edge[x]], pos[edge[x]].astype(np.uint32), again[x]))) for b, x in dealt(h[edge], buckets)]
            # the rest of a repeated anchor is known to be repeated
            rest = np.flatnonzero(~first)
            out += [(b, REPEATED, _pack((doc[rest[x]], pos[rest[x]].astype(np.uint32)))) for b, x in dealt(doc[rest], buckets)]
            if out:
                yield _rows(out)

    return run


def _count_anchors(length: int, gram: int, buckets: int):
    def run(batches):
        for batch in batches:
            data, offs = K.text_bytes(batch.column(0))
            parts = [anchors(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length, gram)[1] for i, j in K.chunks(offs)]
            if parts:
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield _rows([(b, FRAGMENTS, _pack((h[x], n[x].astype(np.uint32)))) for b, x in dealt(h, buckets)])

    return run


def _often(least: float):
    def run(batches):
        parts = [_unpack(raw) for batch in batches for raw in batch.column(2).to_pylist()]
        if parts:
            h, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at.reshape(-1), np.concatenate([p[1] for p in parts]), len(h))
            if (n >= least).any():
                yield _rows([(0, FRAGMENTS, _pack(h[n >= least]))])

    return run


def hot_anchors(rows: DataFrame, length: int, gram: int, hot: int, share: int, parts: int) -> np.ndarray:
    """Sorted hashes of the anchors that occur about ``hot`` times or more, by the texts
    of one of ``share`` ids; at most one for every ``hot`` anchors of the corpus."""
    some = rows.toDF("id", "t").where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("t")
    found = by_bucket(some.mapInArrow(_count_anchors(length, gram, parts), _ROW), parts).mapInArrow(_often(hot / share), _ROW).collect()
    return np.sort(np.concatenate([_NONE, *(_unpack(r["payload"]) for r in found)]))


def _banded(prefix, h, pos, lo, hi, doc, hot: np.ndarray, length: int):
    """The fragments with those of hot anchors cut into bands; a band's hash is that
    of the bytes which all windows of these distances from the anchor hold."""
    if not len(hot) or not len(h):
        return h, pos, lo, hi, doc
    is_hot = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
    if not is_hot.any():
        return h, pos, lo, hi, doc
    out = [tuple(x[~is_hot] for x in (h, pos, lo, hi, doc))]
    h, pos, lo, hi, doc = (x[is_hot] for x in (h, pos, lo, hi, doc))
    for near in range(0, length, BAND):
        first, last = np.maximum(lo, pos - near - BAND + 1), np.minimum(hi, pos - near)
        x = np.flatnonzero(first <= last)
        common = K.span_hash(prefix, pos[x] - near, pos[x] - near - BAND + 1 + length)
        out.append((K.mix(common + K.mix(h[x] + np.uint64(near))), pos[x], first[x], last[x], doc[x]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _find_repeated(buckets: int):
    def run(batches):
        parts = []
        for batch in batches:
            keep = []
            for b, kind, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == REPEATED:
                    keep.append((b, kind, raw))
                else:
                    parts.append(_unpack(raw))
            if keep:
                yield _rows(keep)
        if not parts:
            return
        h, doc, pos, again = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(h, kind="stable")
        h, doc, pos, again = h[order], doc[order], pos[order], again[order]
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[edge, len(h)])
        head = np.repeat(edge, size)
        elsewhere = again | (doc != doc[head]) | (pos != pos[head])
        twice = np.flatnonzero(np.repeat(np.logical_or.reduceat(elsewhere, edge), size))
        out = [(b, REPEATED, _pack((doc[twice[x]], pos[twice[x]]))) for b, x in dealt(doc[twice], buckets)]
        for i in range(0, len(out), 500):
            yield _rows(out[i : i + 500])

    return run


# --- documents -------------------------------------------------------------


def _send_texts(length: int, buckets: int):
    """Each distinct text of a batch to its digest's home; the copies of a batch
    are removed whole."""

    def run(batches):
        for batch in batches:
            ids = _ids(batch.column(0))
            data, offs = K.text_bytes(batch.column(1))
            first, digest, times, copies = _distinct(data, offs, ids, length)
            out = []
            for b, x in dealt(digest, buckets):
                texts = [data[offs[i] : offs[i + 1]].tobytes() for i in first[x]]
                out.append((b, TEXTS, _pack((ids[first[x]], digest[x], times[x], [len(t) for t in texts], b"".join(texts)))))
            for b, x in dealt(ids[copies], buckets):
                out.append((b, COPIES, _pack((ids[copies[x]], np.diff(offs)[copies[x]]))))
            if out:
                yield _rows(out)

    return run


def _texts(raw: bytes):
    """(id, digest, times, text) of a packed row."""
    ids, digest, times, sizes, data = _unpack(raw)
    ends = np.cumsum(sizes).tolist()
    for i, d, t, n, end in zip(ids.tolist(), digest.tolist(), times.tolist(), sizes, ends):
        yield i, d, t, data[end - n : end]


class _Home:
    """The texts of a home, read in two rounds so that they stay packed."""

    def __init__(self):
        self.raws: list[bytes] = []
        self.rows: dict[int, int] = {}

    def add(self, raw: bytes) -> None:
        for d in _unpack(raw)[1].tolist():
            self.rows[d] = self.rows.get(d, 0) + 1
        self.raws.append(raw)

    def judged(self):
        """(id, digest, times, text, stands) for every row: ``stands`` is 0 where the
        row stands for its text, 1 for a repeat with the same id, 2 for a copy."""
        least: dict[tuple[int, bytes], int] = {}
        for raw in self.raws:
            for i, d, _, text in _texts(raw):
                if self.rows[d] > 1:
                    least[d, text] = min(i, least.get((d, text), i))
        done: set[tuple[int, bytes]] = set()
        for raw in self.raws:
            for i, d, times, text in _texts(raw):
                stands = 0
                if self.rows[d] > 1:
                    if i > least[d, text]:
                        stands = 2
                    elif (d, text) in done:
                        stands = 1
                    else:
                        done.add((d, text))
                yield i, d, times, text, stands


def _send_fragments(length: int, gram: int, buckets: int, hot: np.ndarray = _NONE):
    def run(batches):
        known: list = []
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def lists():
            keys = np.concatenate([k[0] for k in known]) if known else np.zeros(0, np.int64)
            places = np.concatenate([k[1] for k in known]) if known else np.zeros(0, np.uint32)
            by = np.argsort(keys, kind="stable")
            return keys[by], places[by]

        home = _Home()
        for batch in batches:
            for kind, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == REPEATED:
                    known.append(_unpack(raw))
                elif kind == TEXTS:
                    home.add(raw)
        wanted = lists()
        for i, d, _, text, stands in home.judged():
            if stands or len(text) < length:
                continue
            at = int(np.searchsorted(wanted[0], d))
            if at < len(wanted[0]) and wanted[0][at] == d:
                held.append((i, d, text))
                size += len(text)
            if size >= GATHER:
                yield from send(held, wanted)
                held, size = [], 0
        yield from send(held, wanted)

    def send(held, wanted):
        if not held:
            return
        keys, places = wanted
        ids = np.array([x[0] for x in held], np.int64)
        digest = np.array([x[1] for x in held], np.int64)
        offs = np.r_[0, np.cumsum([len(x[2]) for x in held])].astype(np.int64)
        data = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
        pairs = np.sort(_pair(keys, places))
        parts = []
        for i, j in K.chunks(offs):
            part, po = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            pos, h, lo, hi = anchors(part, po, length, gram)
            doc = np.searchsorted(po, pos, "right") - 1
            key = _pair(digest[i + doc], pos - po[doc])
            yes = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key
            prefix = K.prefix_hash(part)
            h, pos, lo, hi, doc = _banded(prefix, h[yes], pos[yes], lo[yes], hi[yes], doc[yes], hot, length)
            n = hi - lo + length
            same = _same_key(prefix, lo, n, h)
            parts.append((h, same, ids[i + doc], digest[i + doc], lo - po[doc], hi - lo + 1, pos - lo, lo + offs[i]))
        h, same, fid, frow, start, windows, lead, place = (np.concatenate(x) for x in zip(*parts))
        n = windows + length - 1
        order, group, late = _first_of_equals(same, fid, frow, start)
        late &= _same_bytes(data, place[order], n[order], group)
        x = order[late]  # an equal fragment of this task precedes: all its windows go
        out = _removed([(fid[x], frow[x], start[x], start[x] + windows[x] - 1)], buckets)
        x = order[~late]
        x = x[np.argsort(h[x], kind="stable")]
        for b, y in dealt(h[x], buckets):
            y = x[y]
            out.append((b, FRAGMENTS, _pack((h[y], fid[y], frow[y], start[y].astype(np.uint32), windows[y].astype(np.uint16), lead[y].astype(np.uint16), _gather(data, place[y], n[y])))))
        for i in range(0, len(out), 200):
            yield _rows(out[i : i + 200])

    return run


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for (digest, position): a mixed hash, which may only add anchors."""
    return K.mix(a.astype(np.int64).view(np.uint64)) + b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _same_key(prefix: np.ndarray, at: np.ndarray, size: np.ndarray, h: np.ndarray) -> np.ndarray:
    return K.mix(K.span_hash(prefix, at, at + size) + h) + size.astype(np.uint64)


def _first_of_equals(key: np.ndarray, ids: np.ndarray, rows: np.ndarray, start: np.ndarray):
    """Of entries with equal keys: the order (key, id, row, start), each one's
    group, and which of them another one precedes."""
    order = np.lexsort((start, rows, ids, key))
    key, ids, rows = key[order], ids[order], rows[order]
    new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    least = ids[np.flatnonzero(new)][group] if len(key) else ids
    same_row = np.r_[False, ~new[1:] & (ids[1:] == ids[:-1]) & (rows[1:] == rows[:-1])] if len(key) else new
    return order, group, (ids > least) | same_row


def _gather(data: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[at:at+size] of all spans, one after the other."""
    if not len(at):
        return np.zeros(0, np.uint8)
    first = np.cumsum(size) - size
    return data[np.repeat(at - first, size) + np.arange(int(size.sum()))]


def _same_bytes(data: np.ndarray, at: np.ndarray, size: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each span's bytes equal those of the first span of its group."""
    if not len(at):
        return np.zeros(0, bool)
    head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[group]
    same = size == size[head]
    every = np.flatnonzero(same & (head != np.arange(len(at))) & (size > 0))
    for i, j in K.chunks(np.r_[0, np.cumsum(size[every])], SLICE):
        x = every[i:j]
        differ = _gather(data, at[x], size[x]) != _gather(data, at[head[x]], size[x])
        edge = np.cumsum(size[x]) - size[x]
        same[x] = ~np.logical_or.reduceat(differ, edge)
    return same


def _removed(gone: list[tuple], buckets: int) -> list[tuple]:
    if not gone:
        return []
    ids, rows, lo, hi = (np.concatenate(x) for x in zip(*gone))
    return [(b, REMOVED, _pack((ids[x], rows[x], lo[x].astype(np.uint32), hi[x].astype(np.uint32)))) for b, x in dealt(rows, buckets)]


# --- suffix sort -----------------------------------------------------------


class Suffixes:
    """Suffixes of one byte array, compared by their first ``length`` bytes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix = K.prefix_hash(data)
        self.back = K.powers(K._BASE_INV, len(self.prefix))
        self.steps = int(length).bit_length()

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix by binary search over prefix hashes."""
        ha, hb, ia, ib = self.prefix[a], self.prefix[b], self.back[a], self.back[b]
        out = np.full(len(a), self.length)
        whole = (self.prefix[a + self.length] - ha) * ia == (self.prefix[b + self.length] - hb) * ib
        rest = np.flatnonzero(~whole)
        a, b, ha, hb, ia, ib = (x[rest] for x in (a, b, ha, hb, ia, ib))
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length - 1)
        for _ in range(self.steps):
            mid = (low + high + 1) >> 1
            same = (self.prefix[a + mid] - ha) * ia == (self.prefix[b + mid] - hb) * ib
            low = np.where(same, mid, low)
            high = np.where(same, high, mid - 1)
        out[rest] = low
        return out

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether suffix a sorts before suffix b; ``ties`` where they are equal."""
        n = self.common(a, b)
        equal = n >= self.length
        at = np.where(equal, 0, n)
        return np.where(equal, ties, self.data[a + at] < self.data[b + at])

    def sort(self, start: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Order of the suffixes within each group (groups are contiguous), a
        stable bottom-up mergesort; all groups advance together.  It begins from the
        order of the first eight bytes, and two runs whose border is in order are one
        run already and are left as they are."""
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[edge, len(group)])
        first8 = np.zeros(len(start), np.uint64)
        for i in range(min(8, self.length)):
            first8 = first8 << np.uint64(8) | self.data[start + i].astype(np.uint64)
        order = np.lexsort((first8, group))
        width = 1
        while width < size.max():
            pairs = -(-(size - width).clip(0) // (2 * width))
            base = np.repeat(edge, pairs) + 2 * width * (np.arange(int(pairs.sum())) - np.repeat(np.cumsum(pairs) - pairs, pairs))
            last = np.repeat(edge + size, pairs)
            right = start[order[base + width]]
            turn = np.flatnonzero(self.before(right, start[order[base + width - 1]], np.zeros(len(base), bool)))
            base, last = base[turn], last[turn]
            many = np.minimum(base + 2 * width, last) - base
            x = np.repeat(base, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            first, end = np.repeat(base, many), np.repeat(base + many, many)
            left = x < first + width
            # the place among the other run, by binary search
            low = np.where(left, first + width, first)
            high = np.where(left, end, first + width)
            begin, me = low.copy(), start[order[x]]
            for _ in range(int(width).bit_length()):
                live = np.flatnonzero(low < high)
                if not len(live):
                    break
                mid = (low[live] + high[live]) >> 1
                # a left element goes before equal right ones
                further = self.before(start[order[mid]], me[live], ~left[live])
                low[live] = np.where(further, mid + 1, low[live])
                high[live] = np.where(further, high[live], mid)
            own = np.where(left, x - first, x - first - width)
            merged = order.copy()
            merged[first + own + (low - begin)] = order[x]
            order = merged
            width *= 2
        return order

    def classes(self, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sorted order and, for it, the class of equal windows of each suffix."""
        order = self.sort(start, group)
        s, g = start[order], group[order]
        near = np.flatnonzero(g[1:] == g[:-1])
        equal = near[self.common(s[near], s[near + 1]) >= self.length]
        span = np.arange(self.length)
        same = np.ones(len(equal), bool)
        for i in range(0, len(equal), 1 << 16):  # collision check, in slices
            e = equal[i : i + (1 << 16)]
            same[i : i + (1 << 16)] = (self.data[s[e][:, None] + span] == self.data[s[e + 1][:, None] + span]).all(1)
        if not same.all():
            return self._by_bytes(start, group)
        new = np.ones(len(s), bool)
        new[equal + 1] = False
        return order, np.cumsum(new) - 1

    def _by_bytes(self, start, group):
        text = [self.data[i : i + self.length].tobytes() for i in start]
        order = np.array(sorted(range(len(start)), key=lambda i: (group[i], text[i], i)))
        new = np.array([True] + [group[a] != group[b] or text[a] != text[b] for a, b in zip(order[1:], order)])
        return order, np.cumsum(new) - 1


def _slices(anchor: np.ndarray, lead: np.ndarray, n: np.ndarray):
    """(fragments, first window, number of windows) of about WINDOWS windows each: runs
    of anchors, and of an anchor with more the distances from it by ranges."""
    edge = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1], True]) if len(anchor) else np.zeros(1, np.int64)
    ends = np.r_[0, np.cumsum(n)][edge]
    for i, j in K.chunks(ends, WINDOWS):
        x = np.arange(edge[i], edge[j])
        if ends[j] - ends[i] <= WINDOWS:
            yield x, np.zeros(len(x), np.int64), n[x]
            continue
        low, high = int((lead[x] - n[x]).min()) + 1, int(lead[x].max()) + 1
        width = max(1, WINDOWS // len(x))
        for near in range(low, high, width):
            first = np.maximum(lead[x] - near - width + 1, 0)
            many = np.minimum(lead[x] - near, n[x] - 1) - first + 1
            yield x[many > 0], first[many > 0], many[many > 0]


def _window_hashes(data: np.ndarray, at: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the ``n`` windows of each span, which starts at ``at``."""
    out = []
    for i, j in K.chunks(np.r_[0, np.cumsum(n + length - 1)]):
        many = n[i:j]
        size = many + length - 1
        prefix = K.prefix_hash(_gather(data, at[i:j], size))
        start = np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        out.append(K.span_hash(prefix, start, start + length))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _pieces(key: np.ndarray, at: np.ndarray, own: np.ndarray, size: np.ndarray, data: np.ndarray, length: int):
    """Runs of windows, which are ordered by key, whose fragments have about SLICE bytes.
    A run that begins inside a key holds the key's first window and the one before its
    own as well; where windows of one key differ, all are one run."""
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
    if size[np.unique(own)].sum() <= 2 * SLICE or not _same_bytes(data, at, np.full(len(at), length), group).all():
        yield np.arange(len(key))
        return
    head = np.searchsorted(group, group)
    for i, j in K.chunks(np.r_[0, np.cumsum(size[own])], SLICE):
        yield np.r_[np.unique([head[i], i - 1])[: 2 if head[i] < i else 0], np.arange(i, j)].astype(np.int64)


def repeats(h, ids, rows, start, windows, lead, data, length: int):
    """Windows of the fragments that an equal window precedes: (id, row, first
    start, last start) runs.  ``lead``: bytes of a fragment before its anchor."""
    size = windows.astype(np.int64) + length - 1
    place = np.cumsum(size) - size
    start, windows, lead = start.astype(np.int64), windows.astype(np.int64), lead.astype(np.int64)
    gone = []
    # equal fragments: the first one stands for all
    key = np.zeros(len(h), np.uint64)
    for i, j in K.chunks(np.r_[0, np.cumsum(size)]):
        part = data[place[i] : place[j - 1] + size[j - 1]]
        key[i:j] = _same_key(K.prefix_hash(part), place[i:j] - place[i], size[i:j], h[i:j])
    order, group, late = _first_of_equals(key, ids, rows, start)
    late &= _same_bytes(data, place[order], size[order], group)
    x = order[late]
    gone.append((ids[x], rows[x], start[x], start[x] + windows[x] - 1))
    x = order[~late]
    x = x[np.lexsort((start[x], rows[x], ids[x], h[x]))]
    anchor = np.cumsum(np.r_[True, h[x][1:] != h[x][:-1]]) - 1
    more = (np.bincount(anchor) > 1)[anchor]
    x, anchor = x[more], anchor[more]
    for y, first, n in _slices(anchor, lead[x], windows[x]):
        gone += _late_windows(x[y], anchor[y], first, n, ids, rows, start, lead, place, data, length)
    return gone


def _late_windows(x, anchor, first, n, ids, rows, start, lead, place, data, length: int):
    """Of ``n`` windows of each fragment x, from its window ``first`` on, those that an
    equal one precedes.  Fragments of an anchor are ordered by id, row and start."""
    # suffixes that start a window, by anchor and by their distance from it
    own = np.repeat(np.arange(len(x)), n)
    step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n - first, n)
    group = anchor[own] * np.int64(1 << 16) + lead[x][own] - step + (1 << 15)
    key = K.mix(_window_hashes(data, place[x] + first, n, length) + K.mix(group.view(np.uint64)))
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.r_[False, key[1:] == key[:-1], False]
    more = same[1:] | same[:-1]  # a window of its own has no equal
    key, order = key[more], order[more]
    own, step, group = own[order], step[order], group[order]
    gone = []
    for piece in _pieces(key, place[x[own]] + step, own, n + length - 1, data, length) if len(own) else ():
        used, f = np.unique(own[piece], return_inverse=True)
        f = f.reshape(-1)
        size = n[used] + length - 1
        near = _gather(data, place[x[used]] + first[used], size)
        at = (np.cumsum(size) - size)[f] + step[piece] - first[used][f]
        by = np.lexsort((step[piece], own[piece], group[piece]))
        piece, at = piece[by], at[by]
        _, inner = np.unique(group[piece], return_inverse=True)
        sorted_, cls = Suffixes(near, length).classes(at, inner.reshape(-1))
        w = piece[sorted_]
        f = x[own[w]]
        sid, srow, sstart = ids[f], rows[f], start[f] + step[w]
        inner, _, late = _first_of_equals(cls, sid, srow, sstart)
        y = inner[late]
        y = y[np.lexsort((sstart[y], srow[y], sid[y]))]
        if len(y):
            i, r, s = sid[y], srow[y], sstart[y]
            new = np.r_[True, (i[1:] != i[:-1]) | (r[1:] != r[:-1]) | (s[1:] > s[:-1] + 1)]
            a = np.flatnonzero(new)
            gone.append((i[a], r[a], s[a], s[np.r_[a[1:], len(y)] - 1]))
    return gone


def _sort_fragments(length: int, buckets: int):
    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            keep = []
            for b, kind, raw in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == FRAGMENTS:
                    held.setdefault(b, []).append(raw)
                else:
                    keep.append((b, kind, raw))
            if keep:
                yield _rows(keep)
        for b in list(held):
            columns = [np.concatenate(c) for c in zip(*map(_unpack, held.pop(b)))]
            out = _removed(repeats(*columns, length), buckets)
            if out:
                yield _rows(out)

    return run


# --- result ----------------------------------------------------------------

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _unite(length: int, text: bool, names: list[str]):
    def run(batches):
        cuts: dict[tuple[int, int], list] = {}
        home = _Home()
        out: list[tuple] = []
        for batch in batches:
            for kind, raw in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if kind == REMOVED:
                    ids, rows, lo, hi = _unpack(raw)
                    order = np.lexsort((rows, ids))
                    ids, rows, lo, hi = ids[order], rows[order], lo[order], hi[order]
                    edge = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])])
                    for a, z in zip(edge, np.r_[edge[1:], len(ids)]):
                        cuts.setdefault((int(ids[a]), int(rows[a])), []).append((lo[a:z], hi[a:z]))
                elif kind == COPIES:
                    ids, sizes = _unpack(raw)
                    out += [whole(i, n) for i, n in zip(ids.tolist(), sizes.tolist())]
                elif kind == TEXTS:
                    home.add(raw)
            if out:
                yield result(out)
                out = []
        for i, d, times, data, stands in home.judged():
            out += [whole(i, len(data)) if stands == 2 and len(data) >= length else cut(i, d, data, cuts)] * times
            if len(out) >= 2000:
                yield result(out)
                out = []
        if out:
            yield result(out)

    def whole(i, n):
        """A copy of an earlier text."""
        return i, n, [{"start": 0, "end": n}], hashlib.sha256(b"").hexdigest(), b""

    def cut(i, digest, data, cuts):
        found = cuts.get((i, digest))
        if not found:
            return i, len(data), [], hashlib.sha256(data).hexdigest(), data
        lo = np.concatenate([f[0] for f in found]).astype(np.int64)
        hi = np.concatenate([f[1] for f in found]).astype(np.int64) + length
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        new = np.flatnonzero(np.r_[True, lo[1:] > hi[:-1]])
        lo, hi = lo[new], hi[np.r_[new[1:], len(lo)] - 1]
        kept = b"".join(data[a:z] for a, z in zip(np.r_[0, hi].tolist(), np.r_[lo, len(data)].tolist()))
        return i, len(data), [{"start": a, "end": z} for a, z in zip(lo.tolist(), hi.tolist())], hashlib.sha256(kept).hexdigest(), kept

    def result(out):
        columns = [pa.array([None if o[0] == _NULL else o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], _SPANS), pa.array([o[3] for o in out])]
        return pa.RecordBatch.from_arrays(columns + ([pa.array([o[4] for o in out], pa.binary())] if text else []), names=names)

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH, gram: int = GRAM, text: bool = False, hot: int = HOT, share: int = HOT_SHARE) -> DataFrame:
    """One row per document: id, n_bytes, spans (removed byte ranges, end
    exclusive), kept_sha256, and with ``text`` also ``kept``, the bytes left.
    ``hot`` and ``share``: see ``hot_anchors``; they change no result."""
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = parts
    rows = docs.select(docs[id_col].cast("long"), docs[text_col].cast("string"))
    by = lambda df: by_bucket(df, parts)
    sent = by(rows.mapInArrow(_send_anchors(length, gram, buckets), _ROW)).mapInArrow(_find_repeated(buckets), _ROW)
    texts = rows.mapInArrow(_send_texts(length, buckets), _ROW)
    at_home = by(sent.unionByName(texts))
    fragments = at_home.mapInArrow(_send_fragments(length, gram, buckets, hot_anchors(rows, length, gram, hot, share, parts)), _ROW)
    sorted_ = by(fragments).mapInArrow(_sort_fragments(length, buckets), _ROW)
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    fields = [T.StructField(id_col, T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("spans", span), T.StructField("kept_sha256", T.StringType())]
    if text:
        fields.append(T.StructField("kept", T.BinaryType()))
    return by(sorted_.unionByName(texts)).mapInArrow(_unite(length, text, [f.name for f in fields]), T.StructType(fields))
