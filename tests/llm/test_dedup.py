"""op1, op2, op3 and op7 against brute force on awkward tables."""

import hashlib
import itertools
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import components, exact_dedup, jaccard, packed, passage_dedup, suffix_dedup

from .helpers import awkward, empty, frame, prose, words


# --- exact -----------------------------------------------------------------


def test_exact_classes(spark):
    rows = awkward() + [(99, " One"), (1, "one two")]
    got = {r.doc_id: r for r in exact_dedup.classify(frame(spark, rows)).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    for i, t in norm.items():
        group = [j for j, u in norm.items() if u == t]
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept) == (min(group), len(group), i == min(group))
        assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert got[10].keep_id == got[11].keep_id == 10 and got[12].keep_id == 12


def test_exact_deduplicate_keeps_one_row_and_all_columns(spark):
    docs = frame(spark, [(2, "a  b"), (1, "a b"), (1, "a b"), (None, "a b"), (None, "only"), (None, "only"), (5, None), (4, "")])
    out = exact_dedup.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == [(0, "only"), (1, "a b"), (4, "")]
    assert exact_dedup.classify(empty(spark)).count() == exact_dedup.deduplicate(empty(spark)).count() == 0


def test_exact_digest_clash_compares_texts(spark, monkeypatch):
    """With a digest that says nothing, the whole texts decide."""
    keyed = exact_dedup._keyed
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup, "_keyed", lambda *a: keyed(*a).withColumn("__digest", F.lit(b"same")))
    got = {r.doc_id: r.keep_id for r in exact_dedup.classify(frame(spark, [(1, "a"), (2, "b"), (3, "a")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


# --- byte strings ----------------------------------------------------------


def brute_repeats(rows, length):
    """Removed bytes: windows that an earlier one equals, by id, then by place."""
    first: dict = {}
    for n, (i, t) in enumerate(rows):
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            first.setdefault(b[s : s + length], []).append((i if i is not None else 1 << 62, n, s))
    out = []
    for n, (i, t) in enumerate(rows):
        i = i if i is not None else 1 << 62
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            if any(j < i or (m == n and z < s) for j, m, z in first[b[s : s + length]]):
                gone[s : s + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram", [(100, 24), (40, 16)])
def test_suffix_dedup(spark, length, gram):
    rows = awkward()[:-3] + [(52, "ab" * 400), (53, "Ünï çødé " * 40), (60, prose(40, 3) + prose(90, 5)), (None, prose(120, 5))]
    got = suffix_dedup.remove_repeats(frame(spark, rows), length=length, gram=gram, text=True).collect()
    by_id = {i: w for (i, _), w in zip(rows, brute_repeats(rows, length))}
    assert len(got) == len(rows)
    for r in got:
        n, gone, digest = by_id[r.doc_id]
        assert (r.n_bytes, sum(s.end - s.start for s in r.spans), r.kept_sha256) == (n, gone, digest)
        assert hashlib.sha256(r.kept).hexdigest() == digest
        assert all(a.end < b.start for a, b in itertools.pairwise(r.spans))


def test_suffix_dedup_of_rows_that_repeat_an_id(spark):
    long = prose(60, 4)
    got = sorted(suffix_dedup.remove_repeats(frame(spark, [(1, long), (1, long), (1, "x" + long), (2, long)])).collect(), key=lambda r: (r.doc_id, r.n_bytes))
    assert [sum(s.end - s.start for s in r.spans) for r in got] == [0, 0, 0, len(long)]
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def in_tasks(step, rows):
    """The rows that a step gives for the rows of one task."""
    return [r for batch in step(iter(rows)) for r in zip(*(c.to_pylist() for c in batch.columns))]


def by_bucket(sent):
    groups: dict = {}
    for r in sent:
        groups.setdefault(r[0], []).append(r)
    return [[packed.rows(g)] for g in groups.values()]


def suffix_steps(tables, length, gram, buckets=3):
    """The operator's steps, one task after another."""
    batches = [[pa.RecordBatch.from_arrays([pa.array([i for i, _ in t], pa.int64()), pa.array([x for _, x in t], pa.string())], names=["id", "t"])] for t in tables]
    sent = [r for b in batches for r in in_tasks(suffix_dedup._send_anchors(length, gram, buckets), b)]
    again = [r for g in by_bucket(sent) for r in in_tasks(suffix_dedup._find_repeated(buckets), g)]
    texts = [r for b in batches for r in in_tasks(suffix_dedup._send_texts(length, buckets), b)]
    pieces = [r for g in by_bucket(again + texts) for r in in_tasks(suffix_dedup._send_fragments(length, gram, buckets), g)]
    gone = [r for g in by_bucket(pieces) for r in in_tasks(suffix_dedup._sort_fragments(length, buckets), g)]
    return [r for g in by_bucket(gone + texts) for r in in_tasks(suffix_dedup._unite(length, True, list("abcde")), g)]


@pytest.mark.parametrize("clash", [False, True])
def test_suffix_dedup_compares_texts_of_one_digest(monkeypatch, clash):
    if clash:
        monkeypatch.setattr(suffix_dedup, "_digests", lambda data, offs: np.zeros(len(offs) - 1, np.int64))
    base = prose(60, 5)
    rows = [(1, "A" * 150), (2, "B" * 150), (3, base), (4, base), (5, "new " + base), (6, "B" * 150), (7, ""), (8, None), (9, "short"), (10, "short"), (6, "B" * 150)]
    want = sorted((i, n, gone, digest) for (i, _), (n, gone, digest) in zip(rows, brute_repeats([r for r in rows], 100)))
    for tables in ([rows], [rows[:2], rows[2:5], rows[5:]], [[r] for r in rows]):
        got = sorted((i, n, sum(s["end"] - s["start"] for s in spans), digest) for i, n, spans, digest, _ in suffix_steps(tables, 100, 24))
        assert [g for g in got if g[0] != 6] == [w for w in want if w[0] != 6]
        assert [g[2] for g in got if g[0] == 6] == [150, 150]


def test_suffix_sort_orders_and_survives_hash_collisions(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 900).astype(np.uint8)
    start = rng.integers(0, 880, 300)
    group = np.sort(rng.integers(0, 5, 300))
    s = suffix_dedup.Suffixes(data, 12)
    order = s.sort(start, group)
    text = [(group[i], data[start[i] : start[i] + 12].tobytes(), i) for i in order]
    assert text == sorted(text)
    want = s._by_bytes(start, group)
    bad = suffix_dedup.Suffixes(data, 12)
    bad.prefix = np.zeros_like(bad.prefix)  # every comparison of hashes says "equal"
    for got in (s.classes(start, group), bad.classes(start, group)):
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def hot_fragments(n, line):
    """Fragments of one anchor in a line that ``n`` documents hold."""
    rng = np.random.default_rng(1)
    line = np.tile(rng.integers(97, 123, line).astype(np.uint8), (n, 1))
    around = rng.integers(97, 123, (2, n, 76)).astype(np.uint8)
    data = np.ascontiguousarray(np.concatenate([around[0][:, 10:], line, around[1]], 1)[:, :175])
    ids = np.arange(n)
    return np.full(n, 7, np.uint64), ids, ids, np.zeros(n, np.uint32), np.full(n, 76, np.uint16), np.full(n, 76, np.uint16), data.reshape(-1)


def late_windows(gone):
    return {(i, s) for ids, _, lo, hi in gone for i, a, z in zip(ids.tolist(), lo.tolist(), hi.tolist()) for s in range(a, z + 1)}


def test_a_hot_anchor_is_sorted_in_bounded_memory():
    hot = hot_fragments(20000, 60)
    tracemalloc.start()
    gone = suffix_dedup.repeats(*hot, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not late_windows(gone) and peak < 150 << 20


@pytest.mark.parametrize("windows, slice_", [(50, 2000), (1 << 20, 100), (7, 1)])
def test_slices_of_an_anchor_give_what_the_whole_gives(monkeypatch, windows, slice_):
    hot = hot_fragments(60, 130)
    data = hot[-1].reshape(60, 175)
    first: dict = {}
    for i in range(60):
        for s in range(76):
            first.setdefault(data[i, s : s + 100].tobytes(), i)
    want = {(i, s) for i in range(60) for s in range(76) if first[data[i, s : s + 100].tobytes()] < i}
    monkeypatch.setattr(suffix_dedup, "WINDOWS", windows)
    monkeypatch.setattr(suffix_dedup, "SLICE", slice_)
    assert want and late_windows(suffix_dedup.repeats(*hot, 100)) == want


@pytest.mark.parametrize("length, gram", [(100, 24), (40, 16)])
def test_bands_of_hot_anchors_change_no_result(spark, length, gram):
    line = prose(25, 31)
    rows = awkward()[:-3] + [(52, "ab" * 400), (None, prose(120, 5))] + [(100 + i, prose(12 + i, 200 + i) + line + prose(20, 300 + i // 2)) for i in range(12)]
    docs = frame(spark, rows)
    hot = suffix_dedup.hot_anchors(docs.select("doc_id", "text"), length, gram, 2, 1, 4)
    assert len(hot) and (np.diff(hot) > 0).all()
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs, length=length, gram=gram, hot=2, share=1).collect()}
    for (i, _), want in zip(rows, brute_repeats(rows, length)):
        assert (got[i].n_bytes, sum(s.end - s.start for s in got[i].spans), got[i].kept_sha256) == want


# --- fuzzy passages --------------------------------------------------------


def test_passages_are_found_and_clean_texts_left_alone(spark):
    passage = prose(70, 21).split()
    edited = list(passage)
    for at in (12, 30, 47, 58):
        edited[at] = "changed"
    del edited[40]
    rows = [(1, prose(90, 1) + " " + " ".join(passage) + " " + prose(30, 2)), (2, prose(20, 3) + " " + " ".join(edited).upper() + " " + prose(80, 4))]
    rows += [(3, prose(200, 5)), (4, None), (5, ""), (6, " ".join(passage[:30])), (7, " ".join(passage * 2)), (None, " ".join(passage)), (7, "again")]
    got = passage_dedup.passages(frame(spark, rows)).collect()
    pairs = {(r.doc_id, r.source_id) for r in got}
    assert (2, 1) in pairs and {a for a, _ in pairs} == {2, 7} and all(a > b for a, b in pairs)
    hit = next(r for r in got if (r.doc_id, r.source_id) == (2, 1))
    assert hit.start <= 22 and hit.end >= 85 and 4 <= hit.edits <= 8
    assert passage_dedup.passages(empty(spark)).count() == 0


def test_every_exact_passage_is_covered(spark):
    rows = [(i, t) for i, t in awkward() if i is not None]
    covered: dict = {}
    for r in passage_dedup.passages(frame(spark, rows)).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.end))
    seen: dict = {}
    for i, t in sorted(rows):
        w = words(t)
        for s in range(len(w) - 49):
            owner = seen.setdefault(tuple(w[s : s + 50]), i)
            assert owner == i or set(range(s, s + 50)) <= covered.get(i, set())


def test_passages_inside_a_heavily_revised_copy(spark):
    steps = [(60, 60, True)] + [(14, 14, True), (6, 6, False)] * 10
    parts = passage_dedup.best_parts((5, 9), steps, 50, 0.2)
    assert parts and all(z - a >= 50 and n <= 0.2 * (z - a) for a, z, _, _, n in parts)
    assert (parts[0][0], parts[0][2]) == (5, 9) and parts[0][1] >= 65
    # clean runs at both ends and in the middle of revised ones
    steps = [(14, 14, True), (6, 6, False)] * 10
    steps = [*steps, (55, 55, True), *[(6, 6, False), (14, 14, True)] * 20, (52, 52, True)]
    parts = passage_dedup.best_parts((0, 0), steps, 50, 0.2)
    covered = {x for a, z, _, _, _ in parts for x in range(a, z)}
    assert set(range(200, 255)) <= covered and set(range(655, 707)) <= covered
    assert all(z - a >= 50 and n <= 0.2 * (z - a) for a, z, _, _, n in parts)
    clean, rest = prose(60, 31).split(), prose(200, 32).split()
    edited = [f"new{i}" if i % 20 >= 14 else w for i, w in enumerate(rest)]
    got = passage_dedup.passages(frame(spark, [(1, " ".join(clean + rest)), (2, " ".join(clean + edited))])).collect()
    assert set(range(60)) <= {x for r in got for x in range(r.start, r.end)}
    assert all(r.edits <= 0.2 * (r.end - r.start) for r in got)


@pytest.mark.parametrize("ids", [(1, 2, 10, 11, 12, 20), (1, 2, 10, 11, 12, 30)])
def test_exact_passage_whose_parts_are_common_elsewhere(spark, ids):
    a, b = prose(26, 41), prose(26, 42)
    texts = [a, b, f"{a} {b}", a, b, f"{a} {b}"]
    for parts in (1, 6):
        docs = frame(spark, list(zip(ids, texts))).repartition(parts, "doc_id")
        got = passage_dedup.passages(docs).collect()
        assert [(r.source_id, r.start, r.end, r.edits) for r in got if r.doc_id == ids[-1]] == [(10, 0, 52, 0)]


def test_every_window_of_spliced_texts_is_covered(spark):
    piece = [prose(17, 60 + i) for i in range(9)]
    r = np.random.default_rng(4)
    rows = [(i, " ".join(piece[x] for x in r.integers(0, 9, 6))) for i in range(80)]
    covered: dict = {}
    for x in passage_dedup.passages(frame(spark, rows)).collect():
        covered.setdefault(x.doc_id, set()).update(range(x.start, x.end))
    seen: dict = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - 49):
            owner = seen.setdefault(tuple(w[s : s + 50]), i)
            assert owner == i or set(range(s, s + 50)) <= covered.get(i, set())


def passage_steps(tables, buckets=4, words=50, edits=0.2):
    """The operator's steps, one task after another."""
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in t], pa.int64()), pa.array([x for _, x in t])], names=["id", "t"]) for t in tables if t]
    P = passage_dedup
    sent = [r for b in batches for r in in_tasks(P._send_seeds(P.SEED, P.SAMPLE, words, buckets), [b])]
    met = [r for g in by_bucket(sent) for r in in_tasks(P._match_seeds(P.SEED, words, buckets), g)]
    chained = [r for g in by_bucket(met) for r in in_tasks(P._chain(P.SEED, words, buckets), g)]
    texts = [r for b in batches for r in in_tasks(P._send_texts(buckets), [b])]
    cut = [r for g in by_bucket(chained + texts) for r in in_tasks(P._cut(buckets), g)]
    return [r for g in by_bucket(cut) for r in in_tasks(P._align(words, edits, list("abcdefg")), g)]


def test_exact_passages_are_found_however_the_table_is_dealt():
    p = prose(60, 91).split()
    texts = {1: p, 10: p[:47], 11: p[13:], 12: p, 13: p[:47], 14: p[13:]}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    for tables in ([rows], [rows[:1], rows[1:]], [[r] for r in rows], [rows[::2], rows[1::2]], [rows[3:], rows[:3]]):
        assert [r[:4] + r[6:] for r in passage_steps(tables)] == [(12, 1, 0, 60, 0)]


@pytest.mark.parametrize("size, rate, least", [(50, 0.0, 1.0), (50, 0.04, 0.85), (60, 0.05, 0.95), (80, 0.1, 0.8), (100, 0.1, 0.8)])
def test_recall_of_edited_passages(size, rate, least):
    """Passages with changed words, planted in texts that share nothing else,
    dealt over several tasks; the share of them that is covered to four fifths."""
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(20000)]
    draw = lambda n: [vocabulary[min(int(rng.paretovariate(0.6)), 19999)] for _ in range(n)]
    n, rows, truth = 120, [], {}
    for i in range(n):
        passage, before = draw(size), rng.randint(20, 100)
        rows.append((i, " ".join(draw(30) + passage + draw(40))))
        changed = list(passage)
        for at in rng.sample(range(1, size - 1), int(rate * size)):
            changed[at] = f"edit{rng.randrange(10**6)}"
        rows.append((n + i, " ".join(draw(before) + changed + draw(25))))
        truth[n + i] = (before, before + size)
    covered: dict = {}
    for r in passage_steps([rows[k::5] for k in range(5)]):
        covered.setdefault(r[0], set()).update(range(r[2], r[3]))
    assert all(i >= n for i in covered)
    found = sum(len(covered.get(i, set()) & set(range(a, z))) >= 0.8 * size for i, (a, z) in truth.items())
    assert found >= least * n


def test_seeds_are_matched_with_every_earlier_document():
    rng = random.Random(7)
    at = sorted({(rng.randrange(30), rng.randrange(40), rng.randrange(500)) for _ in range(900)})
    rng.shuffle(at)
    h, doc, pos = (np.array(x, t) for x, t in zip(zip(*at), (np.uint64, np.int64, np.int64)))
    got = set(zip(*(x.tolist() for x in passage_dedup.match(h, doc, pos, 40))))
    held: dict = {}
    for x, d, p in sorted(at):
        held.setdefault(x, {}).setdefault(d, []).append(p)
    for docs in held.values():
        for a, b in itertools.permutations(docs, 2):
            if b < a:
                assert {(a, b, p, docs[b][0]) for p in docs[a]} <= got


def test_fuzzy_passage_whose_seeds_are_common_elsewhere():
    """The only document that holds the whole passage is neither the first nor the
    last of any of its seeds."""
    p = prose(60, 61).split()
    edited = ["edit" if i in (15, 30, 45) else w for i, w in enumerate(p)]
    parts = [" ".join(p[i : i + 15]) for i in range(0, 60, 15)]
    mixed = lambda n: [f"{prose(60, 700 + 9 * n + i)} {x} {prose(60, 800 + 9 * n + i)}" for i, x in enumerate(parts)]
    texts = [*mixed(1), f"{prose(40, 71)} {' '.join(p)} {prose(40, 72)}", *mixed(2), f"{prose(30, 73)} {' '.join(edited)} {prose(50, 74)}"]
    rows = list(enumerate(texts))
    for tables in ([rows], [[r] for r in rows], [rows[::2], rows[1::2]]):
        covered = {x for r in passage_steps(tables) if r[:2] == (9, 4) for x in range(r[2], r[3])}
        assert set(range(30, 90)) <= covered


def test_packed_rows_grow_with_tasks_and_buckets_alone(monkeypatch):
    """A task sends a row a bucket, and one on to its own, whatever the size of a
    group of near copies and the number of slices and tasks its matches come from."""
    P, buckets, tables = passage_dedup, 8, 12
    monkeypatch.setattr(P, "_MATCHES", 50)
    base = prose(150, 95).split()
    near = lambda i: " ".join(f"e{i}" if j % 40 == i % 40 else w for j, w in enumerate(base))
    n_matches = []
    for size in (240, 480):
        dealt = [[(i, near(i)) for i in range(t, size, tables)] for t in range(tables)]
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*t)], names=["id", "t"]) for t in dealt]
        sent = [r for b in batches for r in in_tasks(P._send_seeds(P.SEED, P.SAMPLE, 50, buckets), [b])]
        assert sum(r[1] == P.MATCHES for r in sent) <= tables * buckets
        groups = by_bucket(sent)
        met = [in_tasks(P._match_seeds(P.SEED, 50, buckets), g) for g in groups]
        assert all(len(rows) <= buckets + 1 for rows in met)
        n_matches.append(sum(len(packed.unpack(r[2])[0]) for rows in met for r in rows))
        chained = [r for g in by_bucket([r for rows in met for r in rows]) for r in in_tasks(P._chain(P.SEED, 50, buckets), g)]
        cut = [in_tasks(P._cut(buckets), g) for g in by_bucket(chained)]
        assert all(sum(r[1] == P.PARTS for r in rows) == 1 for rows in cut)
    assert n_matches[1] < 2.5 * n_matches[0]


@pytest.mark.parametrize("n, m", [(0, 300), (1, 200), (100, 90), (300, 120), (150, 400)])
def test_long_alignments_cost_as_little_as_whole_ones(n, m):
    rng = np.random.default_rng(n + m)
    a, b = rng.integers(0, 6, n), rng.integers(0, 6, m)
    steps = passage_dedup._long_edits(a, b)
    assert (sum(s for s, _, _ in steps), sum(t for _, t, _ in steps)) == (n, m)
    i = j = 0
    for s, t, good in steps:
        if good:
            assert a[i : i + s].tolist() == b[j : j + t].tolist()
        i, j = i + s, j + t
    whole = passage_dedup._edits(a.tolist(), b.tolist())
    assert sum(max(s, t) for s, t, good in steps if not good) == sum(max(s, t) for s, t, good in whole if not good)


def test_a_passage_in_a_long_gap_between_runs_is_found():
    """Chained runs lie 180 words apart; the words between are equal but for one in
    six, and one of them is left out."""
    a = np.arange(400)
    b = np.delete(np.where((a > 110) & (a < 290) & (a % 6 == 0), a + 1000, a), 200)
    begin, steps = passage_dedup.align(a, b, [(0, 0, 110), (290, 289, 110)])
    assert passage_dedup.best_parts(begin, steps, 50, 0.2) == [(0, 400, 0, 399, 31)]


def test_chaining_takes_the_best_order():
    # the middle run lies off the order of the others
    chain = passage_dedup.chains([(0, 0, 20), (25, 300, 6), (30, 31, 20), (60, 62, 20)])
    assert chain[0] == [(0, 0, 20), (30, 31, 20), (60, 62, 20)] and chain[1] == [(25, 300, 6)]
    tree = passage_dedup.Fenwick(8)
    for place, value in [(3, 1.0), (5, 4.0), (1, 2.0)]:
        tree.put(place, value, place)
    assert [tree.top(i) for i in (0, 1, 4, 7)] == [(float("-inf"), -1), (2.0, 1), (2.0, 1), (4.0, 5)]


# --- n-gram Jaccard --------------------------------------------------------


def brute_components(rows, k=5, percent=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = set()
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            links.add((a, b))
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}, links


@pytest.mark.parametrize("star", [8, 1])
def test_jaccard_components(spark, star):
    rows = awkward()
    want, _ = brute_components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(frame(spark, rows), star=star).collect()}
    assert got == want
    assert got[10] == (0, 10) and got[13] == (1, 13)


def test_jaccard_links_are_complete(spark):
    rows = awkward()
    _, want = brute_components(rows)
    links, membership = jaccard.links_of(frame(spark, rows))
    cls = {r.doc_id: r.class_id for r in membership.collect()}
    got = {(r.a, r.b) for r in links.collect()}
    assert all((min(cls[a], cls[b]), max(cls[a], cls[b])) in got or cls[a] == cls[b] for a, b in want)
    assert got <= {(min(cls[a], cls[b]), max(cls[a], cls[b])) for a, b in want}


def test_jaccard_keeps_one_of_each_group(spark):
    rows = awkward() + [(10, None), (None, "tiny text")]
    want, _ = brute_components([r for r in rows if r[0] is not None])
    docs = frame(spark, rows)
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    assert sorted(x for x in kept if x is not None) == sorted([i for i, (_, c) in want.items() if i == c] + [10]) and None in kept
    assert jaccard.components_of(empty(spark)).count() == jaccard.keep_one(empty(spark)).count() == 0


@pytest.mark.parametrize("order", [1, -1])
def test_jaccard_of_ids_that_name_several_texts(spark, order):
    a, b, c = (prose(80, 700 + i) for i in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (9, c), (8, c + " word"), (8, prose(50, 710)), (0, prose(50, 710)), (1, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components_of(frame(spark, rows[::order]).repartition(3)).collect())
    assert got == [(0, 46, 0), (1, 0, 1), (1, 76, 1), (1, 76, 1), (2, 77, 1), (3, 77, 1), (8, 46, 0), (8, 77, 0), (9, 76, 0)]
    links, _ = jaccard.links_of(frame(spark, rows[::order]))
    assert {(r.a, r.b) for r in links.collect()} >= {(1, 2), (1, 3), (8, 9)}


def test_frequent_shingles_are_the_most_frequent(spark, monkeypatch):
    text = lambda i: f"{prose(6, 1)} {prose(20, i)}"
    docs = frame(spark, [(i, text(i)) for i in range(50)] + [(60 + i, prose(12, 3) + f" x{i}") for i in range(20)])
    for most, want in [(1 << 20, 10), (5, 2), (0, 0)]:
        monkeypatch.setattr(jaccard, "FREQUENT", most)
        found = jaccard._frequent(docs.select("text").coalesce(1), 5)
        assert len(found) == len(set(found.tolist())) and len(found) <= max(most, 0)
        assert len(found) >= min(want, 2)


def test_sketches_never_overstate_the_difference():
    rng = np.random.default_rng(0)
    for n, m, both in [(50, 60, 40), (400, 500, 390), (3, 200, 3), (1, 1, 0)]:
        common = rng.integers(0, 2**63, both).astype(np.uint64)
        a = np.unique(np.r_[common, rng.integers(0, 2**63, n - both).astype(np.uint64)])
        b = np.unique(np.r_[common, rng.integers(0, 2**63, m - both).astype(np.uint64)])
        x, y = (np.frombuffer(jaccard._sketch(s), np.uint64) for s in (a, b))
        assert jaccard._differ(x, y) <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("small", [100, 0])
def test_components_of_a_long_chain(spark, small):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long").repartition(5), small=small).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}
