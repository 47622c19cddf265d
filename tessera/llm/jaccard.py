"""N-gram Jaccard join: a blocked sparse product of the document by n-gram
incidence matrix with itself.

A document's set is its distinct shingles of ``SHINGLE`` words (A-Z lower-cased,
words between ASCII white space); with fewer words, the whole sequence.  Two
documents link when their sets' Jaccard similarity is at least ``PERCENT``/100.

1. *Rows.*  Documents with equal sets form a class, and the product runs over
   classes.  Every set has a 64-bit signature beside its size.
2. *Columns.*  All sets follow one order of the shingles, frequent ones last.
   Linked sets share a shingle among the first n - ceil(t n) + 1 of each, so
   only these columns are multiplied.  (The frequent shingles are at most
   ``FREQUENT`` of those counted over all documents, chosen by a table of count
   levels; they only steer the order, every order gives the same links.)
3. *Blocks.*  Each task packs its entries of a column block into one array; a
   block's entries meet in one task, are sorted by shingle and multiplied.  A
   pair is discarded when its sizes, or its positions in the two sets, bound the
   overlap below the one that the threshold asks for.
4. *Sketches.*  A set's sketch has a bit for each of its hash cells, at least
   two cells a shingle, with the parity of the shingles there.  Two sketches
   differ in no more bits than the sets differ in shingles, so a pair whose
   sketches differ too much is discarded without its texts.
5. *Overlaps.*  For the pairs left the overlap is accumulated over all columns,
   from the texts, in blocks of at most ``PARTNERS`` rows against one row.
6. *Long columns.*  A column with more than ``STAR`` classes (a large group of
   near copies) is first multiplied with its smallest class alone, then in
   ``ROUNDS`` rounds a few pairs of different components are tried for each row,
   and components grow by the links found.  The last round multiplies, in blocks
   of ``BLOCK`` classes, all pairs that are in different components still and
   share a long column: no link between components is lost, and pairs inside a
   component that is known need not be formed.

Equal sets are told by their size and two 64-bit signatures, 128 bits beside the
size; the entries of the product carry one of them, and every pair is verified
by its texts.

Cases: a null or empty text, or one of white space, has an empty set and is
linked with nothing; an id is one node, so rows that repeat an id with different
texts are in one component, whichever of them has the links (the texts of one id
are held together when its pairs are verified); a null id stays alone in its
result row with a null component unless its class has an id; an empty table
gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import settle
from . import kernel as K
from .components import components

SHINGLE = 5
PERCENT = 80
FREQUENT = 1 << 20
STAR = 8
PARTNERS = 256
BLOCK = 2048
ROUNDS = 2
PICKS = 4
COLUMNS = 3
BROADCAST_IDS = 100_000

_NOT_SPACE = ~K.SPACE


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    starts, ends, woff = K.word_spans(data, offs, _NOT_SPACE)
    words = K.word_hashes(data, starts, ends)
    grams = K.gram_hashes(words, k)
    out = []
    for d in range(len(offs) - 1):
        a, b = int(woff[d]), int(woff[d + 1])
        if b - a >= k:
            s = np.sort(grams[a : b - k + 1])
            out.append(s[np.r_[True, s[1:] != s[:-1]]])
        elif b > a:
            out.append(K.gram_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(column, k: int):
    data, offs = K.text_bytes(column)
    for i, j in K.chunks(offs):
        yield from shingle_sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], k)


def _signature(s: np.ndarray) -> int:
    return int(np.sum(K.mix(s * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(1)), dtype=np.uint64).astype(np.int64)) if len(s) else 0


def _second_signature(s: np.ndarray) -> int:
    return int(np.sum(K.mix(s ^ np.uint64(0x9FB21C651E98DF25)), dtype=np.uint64).astype(np.int64)) if len(s) else 0


def _sketch(s: np.ndarray) -> bytes:
    """Parity of the set's shingles in each of 2**j >= 2 n cells."""
    cells = max(64, 1 << (2 * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketch: np.ndarray) -> np.ndarray:
    """The sketch over half as many cells (the last axis holds the words)."""
    half = sketch.shape[-1] // 2
    return sketch[..., :half] ^ sketch[..., half:]


def _differ(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ: at most the sets' difference."""
    while len(a) > len(b):
        a = _folded(a)
    while len(b) > len(a):
        b = _folded(b)
    return int(np.bitwise_count(a ^ b).sum())


def _possible(na, nb, differ, percent):
    """Whether sets of these sizes that differ so much can link."""
    return (na + nb - differ) // 2 >= -(-percent * (na + nb) // (100 + percent))


def members(docs: DataFrame, id_col: str, text_col: str, k: int = SHINGLE) -> DataFrame:
    """id, n (size of the set), its signatures and sketch of every document."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))

    def run(batches):
        for batch in batches:
            got = [(len(s), _signature(s), _second_signature(s), _sketch(s)) for s in _sets(batch.column(1), k)]
            columns = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n", "sig", "sig2", "sketch"])

    fields = [T.StructField("n", T.LongType()), T.StructField("sig", T.LongType()), T.StructField("sig2", T.LongType()), T.StructField("sketch", T.BinaryType())]
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *fields]))


def _frequent(texts: DataFrame, k: int) -> np.ndarray:
    """The most frequent shingles, rarest first: at most FREQUENT of them.

    A batch reports a shingle that 4 of its classes hold; reports are added up."""

    def run(batches):
        for batch in batches:
            known, parts = set(), []
            for s in _sets(batch.column(0), k):
                key = (len(s), _signature(s))
                if key not in known:
                    known.add(key)
                    parts.append(s)
            if not parts:
                continue
            flat = np.concatenate(parts)
            parts.clear()
            flat.sort()
            edge = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
            n = np.diff(np.r_[edge, len(flat)])
            often = n >= 4
            yield pa.RecordBatch.from_arrays([pa.array(flat[edge][often].view(np.int64)), pa.array(n[often])], names=["h", "n"])

    counted = settle(texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "jaccard-counts")
    # by powers of 2**(1/8) of the count: a few hundred rows at most
    level = F.floor(F.log2("n") * 8)
    levels = counted.groupBy(level.alias("level")).agg(F.count("*").alias("m")).orderBy(F.desc("level")).collect()
    room, least, share = FREQUENT, None, 1.0
    for r in levels:
        least, share = r["level"], min(1.0, room / r["m"])
        room -= r["m"]
        if room <= 0:
            break
    if least is None:
        return np.zeros(0, np.uint64)
    in_share = F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < int(share * (1 << 20) * 0.99)  # of the last level, a share that surely fits
    whole = (level > least) | ((level == least) & (F.lit(share >= 1.0) | in_share))
    table = counted.where(whole).toArrow()
    h, n = table["h"].to_numpy().view(np.uint64), table["n"].to_numpy()
    return h[np.lexsort((h, n))]


def _need(n: int, percent: int) -> int:
    """Least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


class _Order:
    """Ranks shingles: infrequent ones by hash, then the frequent ones."""

    def __init__(self, frequent: np.ndarray):
        self.rank = np.argsort(frequent, kind="stable")
        self.sorted = frequent[self.rank]

    def prefix(self, s: np.ndarray, p: int) -> np.ndarray:
        if not len(self.sorted):
            return s[:p]
        at = np.minimum(np.searchsorted(self.sorted, s), len(self.sorted) - 1)
        often = self.sorted[at] == s
        rare = s[~often]
        if len(rare) >= p:
            return rare[:p]
        late = s[often][np.argsort(self.rank[at[often]], kind="stable")]
        return np.concatenate([rare, late])[:p]


def _entries(texts: DataFrame, order, k: int, percent: int, blocks: int) -> DataFrame:
    """Packed matrix entries (shingle, sig, n, position) by column block."""

    def run(batches):
        known: set[tuple[int, int, int]] = set()
        for batch in batches:
            hs, sigs, sizes = [], [], []
            for s in _sets(batch.column(0), k):
                n = len(s)
                if not n:
                    continue
                sig = _signature(s)
                key = (n, sig, _second_signature(s))
                if key in known:
                    continue
                known.add(key)
                hs.append(order.value.prefix(s, n - _need(n, percent) + 1))
                sigs.append(sig)
                sizes.append(n)
            if not hs:
                continue
            count = np.array([len(x) for x in hs])
            h = np.concatenate(hs)
            sig = np.repeat(np.array(sigs, np.int64), count)
            n = np.repeat(np.array(sizes, np.uint32), count)
            pos = (np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)).astype(np.uint32)
            block = ((h >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
            by = np.argsort(block, kind="stable")
            cut = np.searchsorted(block[by], np.arange(blocks + 1))
            here = [b for b in range(blocks) if cut[b] < cut[b + 1]]
            pack = [b"".join(x[by[cut[b] : cut[b + 1]]].tobytes() for x in (h, sig, n, pos)) for b in here]
            yield pa.RecordBatch.from_arrays([pa.array(here, pa.int32()), pa.array(pack, pa.binary())], names=["block", "entries"])

    return texts.mapInArrow(run, "block int, entries binary")


def _unpack(raws: list) -> list[np.ndarray]:
    columns: list[list] = [[], [], [], []]
    for raw in raws:
        m, at = len(raw) // 24, 0
        for c, kind in zip(columns, (np.uint64, np.int64, np.uint32, np.uint32)):
            c.append(np.frombuffer(raw, kind, m, at))
            at += m * np.dtype(kind).itemsize
    return [np.concatenate(c) for c in columns]


def _feasible(na, pa_, nb, pb, percent):
    """Whether sizes and positions leave room for the overlap that a link needs:
    100 o >= percent (na + nb - o)."""
    na, nb, pa_, pb = (x.astype(np.int64) for x in (na, nb, pa_, pb))
    need = -(-percent * (na + nb) // (100 + percent))
    most = np.minimum(pa_, pb) + 1 + np.minimum(na - pa_, nb - pb) - 1
    return (np.minimum(np.minimum(na, nb), most) >= need)


_PRODUCT = "long_column boolean, h long, sa long, na long, pos long, sb long, nb long"


def _product(entries: DataFrame, percent: int, star: int | None, blocks: int) -> DataFrame:
    """Candidate pairs of each column block, and the entries of long columns."""

    def run(batches):
        raws: dict[int, list] = {}
        for batch in batches:
            for b, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raws.setdefault(b, []).append(raw)
        for b in list(raws):
            yield from block(_unpack(raws.pop(b)))

    def block(columns):
        h, sig, n, pos = columns
        order = np.lexsort((n, sig, h))
        h, sig, n, pos = h[order], sig[order], n[order], pos[order]
        same = np.r_[False, (h[1:] == h[:-1]) & (sig[1:] == sig[:-1]) & (n[1:] == n[:-1])]
        h, sig, n, pos = (x[~same] for x in (h, sig, n, pos))
        if not len(h):
            return
        edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[edge, len(h)])
        pairs_a, pairs_b = [], []
        # columns with few classes: every pair, all columns at once by distance
        limit = star or int(size.max())
        few = np.repeat((size >= 2) & (size <= limit), size)
        end = np.repeat(edge + size, size)
        for step in range(1, min(limit, int(size.max()))):
            a = np.flatnonzero(few & (np.arange(len(h)) + step < end))
            if not len(a):
                break
            ok = _feasible(n[a], pos[a], n[a + step], pos[a + step], percent)
            pairs_a.append(a[ok])
            pairs_b.append(a[ok] + step)
        many = np.repeat(size > limit, size)
        if many.any():
            first = np.repeat(edge, size)
            b = np.flatnonzero(many & (first != np.arange(len(h))))
            ok = _feasible(n[first[b]], pos[first[b]], n[b], pos[b], percent)
            pairs_a.append(first[b[ok]])
            pairs_b.append(b[ok])
        if pairs_a:
            a, b = np.concatenate(pairs_a), np.concatenate(pairs_b)
            flip = (sig[b] < sig[a]) | ((sig[b] == sig[a]) & (n[b] < n[a]))
            a, b = np.where(flip, b, a), np.where(flip, a, b)
            table = np.unique(np.stack([sig[a], n[a].astype(np.int64), sig[b], n[b].astype(np.int64)], 1), axis=0)
            for part in np.array_split(table, max(1, len(table) // 50_000)):
                m = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(m, bool)), pa.nulls(m, pa.int64()), pa.array(part[:, 0]), pa.array(part[:, 1]), pa.nulls(m, pa.int64()), pa.array(part[:, 2]), pa.array(part[:, 3])],
                    names=["long_column", "h", "sa", "na", "pos", "sb", "nb"],
                )
        at = np.flatnonzero(many)
        for part in np.array_split(at, max(1, len(at) // 50_000)):
            m = len(part)
            if m:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.ones(m, bool)), pa.array(h[part].view(np.int64)), pa.array(sig[part]), pa.array(n[part].astype(np.int64)), pa.array(pos[part].astype(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
                    names=["long_column", "h", "sa", "na", "pos", "sb", "nb"],
                )

    return entries.repartition(blocks, "block").mapInArrow(run, _PRODUCT)


def _verify(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of representatives that link, with their overlap.

    The partners of a representative are dealt over blocks of about PARTNERS."""
    counted = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).alias("parts"))
    dealt = pairs.join(counted, "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    wanted = dealt.select("a", "part", F.col("b").alias("id"))
    own = counted.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("a").alias("id"))
    wanted = settle(wanted.unionByName(own), "jaccard-wanted")
    few = wanted.count() <= BROADCAST_IDS  # then the texts need not move for the join
    rows = docs.join(F.broadcast(wanted) if few else wanted, "id").select("a", "part", "id", "t")
    id_type = rows.schema["id"].dataType

    def run(batches):
        heads, key = {}, None
        for batch in batches:
            a, part, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out = []
            for x, p, i, s in zip(a, part, ids, _sets(batch.column(3), k)):
                if i == x:  # the rows of the id itself come first
                    if key != (x, p):
                        heads, key = {}, (x, p)
                    heads[_signature(s), len(s)] = s
                    continue
                assert key == (x, p)
                found = [len(np.intersect1d(head, s, assume_unique=True)) for head in heads.values()]
                best = [both for both, head in zip(found, heads.values()) if both and 100 * both >= percent * (len(head) + len(s) - both)]
                if best:
                    out.append((x, i, max(best)))
            if out:
                kind = batch.schema.field(0).type
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], kind), pa.array([o[1] for o in out], kind), pa.array([o[2] for o in out], pa.int64())], names=["a", "b", "overlap"])

    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("overlap", T.LongType())])
    placed = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("id") != F.col("a"))
    return placed.mapInArrow(run, schema)


def _by_sketch(pairs: DataFrame, percent: int) -> DataFrame:
    """Of (a, b, na, nb, ka, kb) the pairs (a, b) whose sketches let them link."""

    def run(batches):
        for batch in batches:
            na, nb = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ka, kb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            ok = [_possible(m, n, _differ(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), percent) for m, n, x, y in zip(na, nb, ka, kb)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    rows = pairs.select("a", "b", "na", "nb", "ka", "kb")
    return rows.mapInArrow(run, T.StructType([rows.schema["a"], rows.schema["b"]]))


class _Block:
    """Rows of a long column: sizes, positions, components and sketches by width."""

    def __init__(self, columns: dict[str, list]):
        self.rep, self.c = columns["rep"], columns["c"]
        self.n, self.pos = np.array(columns["n"]), np.array(columns["pos"])
        self.sketch = [np.frombuffer(x, np.uint64) for x in columns["sketch"]]
        self.width = np.array([len(x) for x in self.sketch])
        self.component = np.unique(np.array(self.c, object).astype(str), return_inverse=True)[1] if self.c else np.zeros(0, int)
        self.row = np.zeros(len(self.c), np.int64)
        self.table = {}
        for w in np.unique(self.width).tolist():
            here = np.flatnonzero(self.width == w)
            self.row[here] = np.arange(len(here))
            full = np.stack([self.sketch[i] for i in here])
            self.table[w] = (full, _folded(full) if w > 1 else None)

    def partners(self, i: int, among: np.ndarray, percent: int) -> list[int]:
        """Which of the rows ``among`` can link with row i, of another component."""
        among = among[self.component[among] != self.component[i]]
        n, pos = self.n[among], self.pos[among]
        among = among[_feasible(np.full(len(among), self.n[i]), np.full(len(among), self.pos[i]), n, pos, percent)]
        out = []
        w = int(self.width[i])
        for width in np.unique(self.width[among]).tolist():
            js = among[self.width[among] == width]
            if width == w:
                mine, theirs = self.sketch[i], self.table[width][0]
            elif width == 2 * w:
                mine, theirs = self.sketch[i], self.table[width][1]
            elif 2 * width == w:
                mine, theirs = _folded(self.sketch[i]), self.table[width][0]
            else:  # sizes that far apart don't link
                continue
            differ = np.bitwise_count(theirs[self.row[js]] ^ mine).sum(1).astype(np.int64)
            out += js[_possible(self.n[i], self.n[js], differ, percent)].tolist()
        return out


def _multiply_long(rows: DataFrame, percent: int, picks: int | None = None, salt: int = 0) -> DataFrame:
    """Pairs of different components in each (h, x, y): a column's blocks x and y.

    All that their sketches let link, or ``picks`` of each row's."""
    names = ["h", "x", "y", "second", "rep", "c", "n", "pos", "sketch"]

    def run(batches):
        held: dict[str, list] = {}
        key = None
        for batch in batches:
            got = {name: batch.column(i).to_pylist() for i, name in enumerate(names)}
            keys = list(zip(got["h"], got["x"], got["y"]))
            first = 0
            for at in range(1, len(keys) + 1):
                if at == len(keys) or keys[at] != keys[first]:
                    if keys[first] != key:
                        yield from product(held, batch.schema)
                        held, key = {name: [] for name in names}, keys[first]
                    for name in names:
                        held[name] += got[name][first:at]
                    first = at
        if key is not None:
            yield from product(held, batch.schema)

    def product(held, schema):
        if not held:
            return
        block = _Block(held)
        second = np.array(held["second"], bool)
        same = held["x"][0] == held["y"][0]
        size = np.bincount(block.component)
        small = block.component != int(np.argmax(size))  # pairs inside the largest component are none
        a, b = [], []
        for i in np.flatnonzero(small if same else ~second):
            i = int(i)
            if same:
                others = np.flatnonzero(~small | (np.arange(len(small)) > i)) if picks is None else np.arange(len(small))
            else:
                others = np.flatnonzero(second)
            found = block.partners(i, others, percent)
            if picks is not None and len(found) > picks:
                found = sorted(found, key=lambda j: crc32(repr((salt, *sorted((block.rep[i], block.rep[j])))).encode()))[:picks]
            for j in found:
                x, y = block.rep[i], block.rep[j]
                a.append(min(x, y))
                b.append(max(x, y))
        if a:
            kind = schema.field(4).type
            yield pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    kind = rows.schema["rep"].dataType
    placed = rows.select(*names).repartition("h", "x", "y").sortWithinPartitions("h", "x", "y")
    return placed.mapInArrow(run, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


class JaccardJoin:
    """The join over one table; each step is a written table."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = SHINGLE, percent: int = PERCENT, star: int | None = STAR):
        self.k, self.percent, self.star = shingle, percent, star
        self.docs = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
        self.id_col = id_col
        self.members = settle(members(docs, id_col, text_col, shingle), "jaccard-members")
        self.classes = settle(self.members.where("n > 0").groupBy("sig", "n", "sig2").agg(F.min("id").alias("rep"), F.min("sketch").alias("sketch")), "jaccard-classes")
        self._multiply()

    def _multiply(self) -> None:
        spark = self.docs.sparkSession
        texts = self.docs.select("t")
        order = spark.sparkContext.broadcast(_Order(_frequent(texts, self.k)))
        blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.product = settle(_product(_entries(texts, order, self.k, self.percent, blocks), self.percent, self.star, blocks), "jaccard-product")
        of = lambda x: self.classes.select(F.col("sig").alias(f"s{x}"), F.col("n").alias(f"n{x}"), F.col("rep").alias(f"r{x}"), F.col("sketch").alias(f"k{x}"))
        pairs = self.product.where("not long_column").select("sa", "na", "sb", "nb").distinct()
        pairs = pairs.join(of("a"), ["sa", "na"]).join(of("b"), ["sb", "nb"])
        pairs = _by_sketch(pairs.withColumnsRenamed({"ra": "a", "rb": "b"}), self.percent)
        self.tested = settle(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "jaccard-pairs")
        self.links = settle(_verify(self.tested, self.docs, self.k, self.percent), "jaccard-links")

    def _merge(self, labels: DataFrame | None, links: DataFrame) -> DataFrame:
        """(node, component) after more links; classes by themselves have no row."""
        edges = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        if labels is None:
            return settle(components(edges, "jaccard-components"), "jaccard-labels")
        for end in ("u", "v"):
            of = labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
            edges = edges.join(of, end, "left").withColumn(end, F.coalesce(f"c{end}", end)).drop(f"c{end}")
        step = settle(components(edges, "jaccard-components"), "jaccard-step")
        root = step.select(F.col("node").alias("component"), F.col("component").alias("root"))
        moved = labels.join(root, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        return settle(moved.unionByName(step), "jaccard-labels")

    def _across(self, labels: DataFrame, picks: int | None, salt: int) -> DataFrame:
        """Pairs of different components that share a long column and are not tested."""
        long = self.long.join(labels, self.long["rep"] == labels["node"], "left").drop("node").withColumn("c", F.coalesce("component", "rep")).drop("component")
        if picks is not None:  # a few of each class's columns are enough to grow components
            by = Window.partitionBy("rep").orderBy(F.xxhash64("h", F.lit(salt)))
            long = long.withColumn("__n", F.row_number().over(by)).where(F.col("__n") <= COLUMNS).drop("__n")
        sizes = long.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        long = long.join(sizes.where("c1 <> c2").select("h", "blocks"), "h").withColumn("own", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
        # a row takes part in the product of its block with every block of the column
        long = long.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        long = long.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other"), "second": F.col("own") > F.col("other")})
        pairs = _multiply_long(long, self.percent, picks, salt).distinct()
        return pairs.join(self.tested, ["a", "b"], "left_anti")

    def _of_one_id(self) -> DataFrame:
        """Edges (a, b) from an id that has several sets to their classes."""
        sets = self.members.where("n > 0 and id is not null")
        key = F.struct("sig", "n", "sig2")
        several = settle(sets.groupBy("id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).where("lo <> hi").select("id"), "jaccard-several")
        met = sets.join(several, "id", "left_semi").join(self.classes.select("sig", "n", "sig2", "rep"), ["sig", "n", "sig2"])
        return met.select(F.least("rep", "id").alias("a"), F.greatest("rep", "id").alias("b")).where("a <> b").distinct()

    def _grow(self) -> DataFrame:
        """Labels of all classes that are linked."""
        labels = self._merge(None, self.links.select("a", "b").unionByName(self._of_one_id()))
        if self.star is None or self.product.where("long_column").isEmpty():
            return labels
        long = self.product.where("long_column").select("h", F.col("sa").alias("sig"), F.col("na").alias("n"), "pos")
        self.long = settle(long.join(self.classes, ["sig", "n"]).select("h", "rep", "n", "pos", "sketch"), "jaccard-long")
        for salt in range(ROUNDS + 1):
            picks = PICKS if salt < ROUNDS else None
            more = settle(self._across(labels, picks, salt), "jaccard-across")
            if more.isEmpty():
                continue
            found = settle(_verify(more, self.docs, self.k, self.percent), "jaccard-links")
            self.tested = self.tested.unionByName(more)
            self.links = self.links.unionByName(found)
            labels = self._merge(labels, found)
        return labels

    def components(self) -> DataFrame:
        """id, n_shingles, component_id (smallest id reachable by links)."""
        labels = self._grow()
        marked = self.classes.join(labels, self.classes["rep"] == labels["node"], "left").select("sig", "n", "sig2", F.coalesce("component", "rep").alias("component"))
        marked = settle(marked, "jaccard-marked")
        out = self.members.join(marked, ["sig", "n", "sig2"], "left")
        return out.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: id, n_shingles, component_id."""
    return JaccardJoin(docs, id_col, text_col, **options).components()


def links_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> tuple[DataFrame, DataFrame]:
    """All links between classes (a, b, overlap; a and b the classes' smallest
    ids), and the membership (id, class_id, n_shingles).  Every pair of classes
    that share a column is formed, so a column of many near copies costs the
    square of their number: that many links are asked for."""
    join = JaccardJoin(docs, id_col, text_col, star=None, **options)
    reps = join.classes.select("sig", "n", "sig2", "rep")
    membership = join.members.join(reps, ["sig", "n", "sig2"], "left")
    links = join.links.groupBy("a", "b").agg(F.max("overlap").alias("overlap"))  # an id with several texts may link twice
    return links, membership.select(F.col("id").alias(id_col), F.coalesce("rep", "id").alias("class_id"), F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The row with the smallest id of each component, columns unchanged; rows
    with an empty set and rows with a null id stay."""
    found = components_of(docs, id_col, text_col, **options)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")
