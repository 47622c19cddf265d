"""op4, op5, op6, op8, op9, op10 and the pipeline on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontam, html_main, lm_score, packed, packing, tokens, toxicity, warc, word_bits
from tessera.llm import kernel as K

from .helpers import LOWER, awkward, empty, frame, prose, words

# --- packing ---------------------------------------------------------------


def test_packing_places_every_id_once_without_padding(spark):
    rows = awkward() + [(7, "<|endoftext|> special"), (None, "no id"), (10, None)]
    pieces = packing.pack(frame(spark, rows)).collect()
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokens.default_path())
    want = collections.Counter((i, tuple(exact.encode(t or "", add_special_tokens=False).ids + [1])) for i, t in rows)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        by_sequence[p.sequence_id].append(p)
        by_doc[p.doc_id, p.doc_tokens].append(p)
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        assert [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1]]
        total = sum(p.length for p in s)
        assert total == 2048 or (total <= 2048 and total & (total - 1) == 0)
    for (i, ids), times in want.items():
        own = sorted((p for p in by_doc[i, len(ids)]), key=lambda p: p.start)
        assert sum(p.length for p in own) >= times * len(ids)
        for p in own:
            if tuple(np.frombuffer(p.ids, "<u4")) == ids[p.start : p.start + p.length]:
                break
        else:
            raise AssertionError(i)
    assert sum(p.length for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    assert packing.pack(empty(spark)).count() == 0


def test_packing_respects_all_limits():
    rng = random.Random(3)
    examples = [(i, rng.randint(1, 300), rng.randint(0, 120)) for i in range(400)]
    placed = collections.defaultdict(list)
    for sequence in packing.pack_examples(examples, length=256, segments=5, loss=128, wait=32):
        total = sum(p.tokens for p in sequence)
        assert total <= 256 and len(sequence) <= 5 and sum(p.loss() for p in sequence) <= 128
        assert total == 256 or total & (total - 1) == 0
        for p in sequence:
            placed[p.example].append((p.start, p.tokens))
    for i, n, _ in examples:
        at = 0
        for start, size in sorted(placed[i]):
            assert start == at
            at += size
        assert at == n


# --- archive ---------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big, other = "<p>é\r\n\r\nWARC/1.1</p>" * 90, "x" * 1000
    rows = [(1, "http://a/1", big), (5, "http://a/5", big), (3, None, big), (4, "u\r\nv", other), (2, "http://b", "small"), (6, "http://c", "small"), (7, "http://d", None), (8, "", other), (8, "", other), (None, "n", big)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, sha256 int")
    path = f"file://{tmp_path}/warc"
    warc.write(pages, path)
    got = warc.read(spark, path).collect()
    want = collections.Counter((i, (u or "").replace("\r", " ").replace("\n", " "), h or "") for i, u, h in rows)
    assert collections.Counter((r.id, r.url, r.payload) for r in got) == want
    kinds = {(r.id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(5, "response", None), (1, "revisit", 5), (3, "revisit", 5), (None, "revisit", 5), (4, "revisit", 8), (8, "response", None), (8, "revisit", 8), (2, "response", None), (6, "response", None), (7, "response", None)}
    assert all(r.sha1 == hashlib.sha1(r.payload.encode()).hexdigest() and r.payload_bytes == len(r.payload.encode()) for r in got)
    stored = warc.parse(spark, f"{path}/payloads").collect()
    assert sum(len(r.payload) for r in stored) == len(big) + len(other) + 2 * len("small")


def test_warc_notices_damage_and_takes_empty_tables(spark, tmp_path):
    path = f"file://{tmp_path}/none"
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read(spark, path).count() == 0
    whole = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pieces = lambda data: data.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n")
    assert [b for _, b in warc.records(pieces(whole * 2))] == [b"abc"] * 2
    for bad in (whole[:-2], whole.replace(b"3", b"2"), b"HTTP" + whole[4:], whole + whole[:-6], whole.replace(b"3", b"9")):
        with pytest.raises(ValueError):
            list(warc.records(pieces(bad)))


def test_warc_of_large_payloads_and_odd_line_ends(spark, tmp_path):
    odd = ["\r\n", "a\r\n", "b\r", "\n", "\r\n\r\n", "c\r\n\r\n\r\n", "\r\n\r\n\r\n\r\nd\r", "WARC/1.1\r\nContent-Length: 0\r\n\r\n", "e" + "\r\n" * 7, "\ud7ff\U00010400 é"]
    rows = [(i, f"http://o/{i}", x) for i, x in enumerate(odd)] + [(100 + i, "u", x * 700) for i, x in enumerate(odd)]
    rows += [(200 + i, "big", f"{i % 3} " + "page\r\n\r\n" * 150_000) for i in range(7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (1, 4 << 20):
        path = f"file://{tmp_path}/odd{size}"
        warc.write(pages.repartition(3), path, file_bytes=size)
        got = warc.read(spark, path).collect()
        assert collections.Counter((r.id, r.url, r.payload) for r in got) == collections.Counter(rows)
        assert {r.id for r in got if r.record_type == "response" and r.id >= 200} == {204, 205, 206}


# --- decontamination -------------------------------------------------------


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_contamination(docs, items):
    out = {}
    for i, t in docs:
        w, hit, ids = item_words(t), set(), set()
        for item, u in items:
            v = item_words(u)
            n = min(8, len(v))
            windows = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n else set()
            for s in range(len(w) - n + 1 if n else 0):
                if tuple(w[s : s + n]) in windows:
                    hit.update(range(s, s + n))
                    ids.add(str(item) if item is not None else "")
        out[i] = (len(w), len(hit), sorted(ids))
    return out


@pytest.mark.parametrize("limit", [10**8, 0])
def test_contamination(spark, limit):
    item = prose(30, 50)
    items = [(1, item), (2, prose(8, 51)), (10, "Solo"), (3, "two-words"), (4, None), (5, "!!"), (None, prose(9, 52)), (2, prose(12, 53)), (1, item)]
    docs = awkward()[:12] + [(70, prose(40, 1) + " " + item.upper().replace(" ", ", ") + " end"), (71, "solo, TWO words; solo"), (72, prose(8, 51) + " " + prose(9, 52)), (73, " ".join(item.split()[3:10])), (74, prose(3000, 8) + " " + prose(12, 53))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(frame(spark, docs), bench, broadcast_bytes=limit).collect()
    want = brute_contamination(docs, items)
    assert len(got) == len(docs)
    for r in got:
        hit = sum(s["last"] - s["first"] + 1 for s in r.spans)
        assert (r.n_words, hit, r["items"]) == want[r.doc_id], r.doc_id
    kept = decontam.decontaminate(frame(spark, docs), bench, broadcast_bytes=limit)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, w in want.items() if len(w[2]) < 2)
    assert kept.columns == frame(spark, docs).columns
    assert decontam.contamination(frame(spark, docs), bench.limit(0), broadcast_bytes=limit).where(F.size("items") > 0).count() == 0
    assert decontam.contamination(empty(spark), bench, broadcast_bytes=limit).count() == 0


def test_contamination_compares_words_where_hashes_clash(monkeypatch):
    """With hashes that say only how many words there are, the words decide."""
    item, other = prose(12, 81), prose(12, 82)
    texts = [prose(9, 83) + " " + item, other, prose(30, 84), "", other.upper() + "; " + item]
    flat = lambda words, k: np.zeros(max(len(words) - k + 1, 0), np.uint64)
    monkeypatch.setattr(decontam.K, "gram_hashes", flat)
    rows = []
    for i, t in (("1", item), ("2", other)):
        w = t.split()
        rows += [(0, 0, 8, i, " ".join(w[j : j + 8]).encode()) for j in range(len(w) - 7)]
    table = pa.table(dict(zip(("fingerprint", "hash", "words", "item", "text"), map(list, zip(*rows)))))
    _, spans, items = decontam._scan(pa.array(texts), decontam._Index(table, 8, 5))
    assert items == [["1"], ["2"], [], [], ["1", "2"]]
    assert spans == [[{"first": 9, "last": 20}], [{"first": 0, "last": 11}], [], [], [{"first": 0, "last": 23}]]


def test_contamination_by_a_shuffle_after_a_shuffle(spark):
    """Rows without an id of their own, dealt anew whenever they are computed."""
    item = prose(40, 85)
    rows = [(i % 3, prose(30, i) + (" " + item if i % 4 == 0 else "")) for i in range(60)] + [(5, "go " * 200)]
    docs = frame(spark, rows).repartition(7)
    bench = spark.createDataFrame([(1, item), (2, "go " * 12), (3, "go " * 9)], "item_id long, text string")
    kept = decontam.decontaminate(docs, bench, min_items=1, broadcast_bytes=0)
    assert sorted(r.text for r in kept.collect()) == sorted(t for i, t in rows if i != 5 and item not in t)
    got = decontam.contamination(docs, bench, broadcast_bytes=0).where("doc_id = 5").first()
    assert (got.n_words, [tuple(s) for s in got.spans], got["items"]) == (200, [(0, 199)], ["2", "3"])


# --- pages -----------------------------------------------------------------


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
    <header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div id="cookieNotice">We use cookies, sorry.</div>
    <div class="layout"><div class="post"><h2>Heading &lt;1&gt;</h2><p>First &eacute; paragraph, with commas,
      and    length enough to count for something in the scores.<p>Second<br>line <b>bold</b> and <a href=x>a link</a>.</p>
    <script>if (a < b) { document.write("</p>") }</script><div class="ad-box">Buy, buy, buy, buy, buy, buy now</div>
    <ul><li>one<li>two</ul><blockquote>quoted, words</blockquote><form><p>Name</p><input></form><p>Short.</p></div></div>
    <aside>Elsewhere, other, things</aside><section class="comments"><p>I, disagree, with, all, of, this, really.</p></section><footer>(c)</footer>"""
    want = ["Heading <1>", "First é paragraph, with commas, and length enough to count for something in the scores.", "Second line bold and a link.", "one", "two", "quoted, words", "Short."]
    assert html_main.extract(page).split("\n") == want


@pytest.mark.parametrize("page, want", [(None, ""), ("", ""), ("<p></p><nav>menu</nav>", ""), ("plain & text", "plain & text"), ("<p>a<p>b", "a\nb"), ("x < y <b>z", "x < y z"), ("<div>" * 3000 + "deep, text", "deep, text"), ("<article><p>one</p></article><p>tail", "one\ntail"), ("<a href='>'>l</a> <p class=\"x>y\">k</p>", "l\nk")])
def test_main_text_of_odd_pages(page, want):
    assert html_main.extract(page) == want


@pytest.mark.parametrize(
    "page, want",
    [
        ('<p>a, b</p><a "x>' + '"' * 2001, "a, b\n" + '"' * 2001),
        ("<p>a, b</p>" + "<a " * 30000, "a, b\n" + ("<a " * 30000).strip()),
        ("<div " + "a" * 100000 + ">a, b</div>", "a, b"),
        ("<article>" + "<div>" * 20000 + "a, b", "a, b"),
        ("<i>" * 20000 + "</b>" * 20000 + "a, b", "a, b"),
        ("<p>" + "long, text " * 200000 + "</p>", ("long, text " * 200000).strip()),
    ],
    ids=["quotes", "no end", "attribute", "nested", "inline", "long"],
)
def test_main_text_of_hostile_pages_takes_linear_time(page, want):
    assert html_main.extract(page) == want


def test_main_text_frame(spark):
    pages = spark.createDataFrame([(1, "u", "<p>Hi there</p>", "x"), (None, None, None, "y"), (1, "u", "<p>Hi there</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.url, r.text) for r in html_main.main_text(pages).collect()) == [(0, None, ""), (1, "u", "Hi there"), (1, "u", "Hi there")]
    assert html_main.main_text(pages.limit(0)).count() == 0


# --- language model --------------------------------------------------------


def test_lm_scores(spark):
    english = [" ".join(random.Random(i).choices("the of and river stone light walked under slowly".split(), k=60)) for i in range(60)]
    latin = [" ".join(random.Random(i).choices("et in terra aqua lumen sub lente via ".split(), k=60)) for i in range(30)]
    rows = [(i, t) for i, t in enumerate(english + latin)] + [(200, None), (201, ""), (202, "zyx wvu"), (203, english[0]), (203, english[0]), (None, "the river"), (204, prose(3000, 3))]
    docs = frame(spark, rows)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 10 == 0
    got = lm_score.scores(docs, held).collect()
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 == 0
    toks = [(i, words(t) + [None]) for i, t in rows]
    count = collections.Counter(w for i, ws in toks if not out(i) for w in ws)
    n, v = sum(count.values()), len(count)
    want = collections.Counter((i, out(i), len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for i, ws in toks)
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    test = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 90]
    assert sum(r.score for r in test) > sum(r.base_score for r in test)
    assert lm_score.scores(empty(spark), held).count() == 0
    none = lm_score.scores(docs, F.lit(True)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_lm_classes_come_from_all_texts(spark):
    """Texts of another alphabet whose ids have the largest hashes make a class."""
    ids = [r.id for r in spark.range(2400).orderBy(F.xxhash64("id")).collect()]
    texts = [" ".join(random.Random(i).choices("the of and river stone light walked under slowly".split(), k=20)) for i in range(2380)]
    other = [" ".join(random.Random(i).choices("река камень свет под берег снова".split(), k=20)) for i in range(20)]
    docs = spark.createDataFrame(list(zip(ids, texts + other)), "id long, t string").repartition(4)
    data, offs = K.text_bytes(pa.array(other))
    found = lm_score._profile(data, offs) @ lm_score._classes(docs).T
    assert (found.max(1) > 0.8).all()


def test_lm_weights_are_learned_from_all_words_and_texts(spark, monkeypatch):
    known = [f"word{i}".encode() for i in range(200)]
    h = np.arange(200, dtype=np.uint64)
    raw = packed.pack((h, np.zeros(200, np.uint8), np.ones(200, np.int64), known))
    got = list(lm_score._vocabulary(1)(iter([packed.rows([(0, lm_score.COUNTS, raw)])])))
    learned = [packed.unpack(r["payload"]) for b in got for r in b.to_pylist() if r["bucket"] == lm_score._LEARN]
    assert sorted(w for x in learned for w in x) == sorted(known)

    def texts_read(model):
        def run(batches):
            n = sum(b.num_rows for b in batches)
            yield packed.rows([(0, lm_score.COUNTS, packed.pack(np.concatenate([np.full((2, 64, 3), float(n)), np.ones((2, 64, 1))], 2)))])

        return run

    seen, ready = [], word_bits.CodeMixer.ready
    monkeypatch.setattr(lm_score, "_learned_codes", texts_read)
    monkeypatch.setattr(word_bits.CodeMixer, "ready", lambda self, weights: (seen.append(weights.max()), ready(self, weights))[1])
    lm_score.scores(frame(spark, [(i, prose(5, i)) for i in range(50)]).coalesce(1), F.col("doc_id") >= 40)
    assert seen == [40]


def test_code_weights_move_by_the_counts_without_the_token(monkeypatch):
    found, cls, mixer = _code_model([prose(300, i) for i in range(3)])
    again = _code_model([prose(300, i) for i in range(3)])[2]
    used = np.zeros(mixer.weights.shape[:2])
    mixer.learn(found.hash, found.place, cls, used)
    codes, around = word_bits.code(found.hash), word_bits.contexts(found.hash, found.place)
    each, want = np.arange(len(codes)), np.zeros_like(used)
    for level in range(2):
        value, seen = word_bits._nibble(codes, level), []
        for table, at in zip(again.rows, again._places(cls, around, codes, level)):
            rows = table[at]
            rows[each, value] -= 1
            seen.append(word_bits._nodes(rows))
        again._bits(value, level, lambda o, node: (seen[o][0][each, node], seen[o][1][each, node]), want)
    assert (used == want).all() and np.allclose(mixer.weights, again.weights, atol=1e-5)


def test_spelling_is_a_probability():
    s = lm_score.Speller(lm_score._spelling_counts([b"aba", b"abba", b"ab"] * 5))
    total = 0.0
    for first in range(256):
        total += 10 ** s.log10([bytes([first])])[0] if first != 32 else 0
    assert 0 < total < 1 and s.log10([b"abba"])[0] > s.log10([b"zqzq"])[0]


def test_classes_count_the_byte_pairs_of_each_text():
    texts = ["", "ab", "a", "", "abab", "zz9 \u00e9"] + [prose(30, i) for i in range(130)] + ["", "x", ""]
    data, offs = K.text_bytes(pa.array(texts))
    got = np.concatenate([x for _, _, x in lm_score._pair_roots(data, offs)])
    for text, row in zip(texts, got):
        raw = lm_score._LETTER[np.frombuffer(text.encode(), np.uint8)].tolist()
        want = collections.Counter(a * 64 + b for a, b in zip(raw, raw[1:]))
        assert {int(k): round(float(row[k]) ** 2) for k in np.flatnonzero(row)} == want
    model = lm_score.Model(lm_score._centres(lm_score._profile(data, offs), 3), None, None, 0)
    assert (model.classify(data, offs) == np.argmax(lm_score._profile(data, offs) @ model.centres.T, 1)).all()
    assert len(model.classify(data[:0], np.zeros(3, np.int64))) == 2


def _code_model(texts, classes=2):
    """Words of the texts, their classes, and the counts of code bits."""
    data, offs = K.text_bytes(pa.array(texts))
    found, cls = lm_score.Words(data, offs), np.arange(len(texts)) % classes
    table = word_bits.no_counts()
    word_bits.add_counts(table, found.hash, found.place)
    by_class = np.zeros((classes, word_bits.CODES), np.int64)
    np.add.at(by_class, (cls[found.doc], word_bits.code(found.hash)), 1)
    return found, cls[found.doc], word_bits.CodeMixer(word_bits.class_rows(by_class), table)


def test_code_bits_against_plain_counts(monkeypatch):
    monkeypatch.setattr(word_bits, "ROW_BITS", 22)  # no two contexts share a row
    found, cls, mixer = _code_model([prose(40, i) for i in range(6)] + ["", "one"])
    codes, h, place = word_bits.code(found.hash).tolist(), found.hash.tolist(), found.place.tolist()
    weights = np.random.default_rng(1).uniform(0.1, 0.6, mixer.weights.shape)

    def near(i):  # the contexts of token i
        before = h[i - 1] if place[i] else None
        return [("class", int(cls[i])), ("one", before), ("two", before, h[i - 2] if place[i] > 1 else None)]

    counts = collections.Counter()
    for i, c in enumerate(codes):
        for x in near(i):
            for b in range(8):
                counts[x, b, c >> (8 - b), (c >> (7 - b)) & 1] += 1
    want = []
    for i, c in enumerate(codes):
        total = 0.0
        for b in range(8):
            n = [[counts[x, b, c >> (8 - b), bit] for bit in (0, 1)] for x in near(i)]
            gate = [min(7, int(math.log2(sum(x) + 1))) for x in n[1:]]
            vote = sum(w * math.log((x[1] + 0.1) / (x[0] + 0.1)) for w, x in zip(weights[b // 4, gate[0] * 8 + gate[1]], n))
            total -= math.log10(1 + math.exp(-vote if (c >> (7 - b)) & 1 else vote))
        want.append(total)
    assert mixer.ready(weights).log10(found.hash, found.place, cls) == pytest.approx(want, abs=1e-4)


def test_code_weights_learn_and_codes_are_probabilities():
    found, cls, mixer = _code_model(["a b c d e f g"] * 40 + [prose(200, 1)])
    used, start = np.zeros(mixer.weights.shape[:2]), mixer.weights.copy()
    mixer.learn(found.hash, found.place, cls, used)
    assert used.sum() == 8 * len(cls) and not np.allclose(mixer.weights, start)
    mixer.ready(mixer.weights)
    third = {int(word_bits.code(x)[0]): x[0] for x in np.random.default_rng(2).integers(1, 1 << 62, (5000, 1)).astype(np.uint64)}
    assert len(third) == word_bits.CODES
    h = np.array([x for last in third.values() for x in (*found.hash[:2], last)], np.uint64)
    got = mixer.log10(h, np.tile(np.arange(3), len(third)), np.zeros(len(h), np.int64))[2::3]
    assert (10**got).sum() == pytest.approx(1, abs=1e-6)


def test_code_weights_learn_without_a_logarithm_a_token(monkeypatch):
    """Votes come from tables: the logarithms taken don't grow with the texts."""
    found, cls, mixer = _code_model([prose(300, i) for i in range(4)])
    taken, learner = collections.Counter(), mixer.learner()

    class Counted:
        def __getattr__(self, name):
            f = getattr(np, name)
            return (lambda x, *a, **k: (taken.update([name] * np.size(x)), f(x, *a, **k))[1]) if name in ("log", "log2", "log1p") else f

    monkeypatch.setattr(word_bits, "np", Counted())
    used = np.zeros(mixer.weights.shape[:2])
    learner.learn(found.hash, found.place, cls, used)
    assert not taken and used.sum() == 8 * len(cls)
    assert not np.allclose(learner.weights, mixer.weights) and mixer.learner().left_out is learner.left_out


def test_repeats_are_mixed_as_by_a_plain_loop():
    texts = ["", "a", "a a a a a a a a a a", prose(70, 3), " ".join(prose(9, 4).split() * 6), "b c b"]
    words = lm_score.Words(*K.text_bytes(pa.array(texts)))
    number = lm_score._distinct(words, np.zeros(len(texts), np.int64))[1]
    fresh = np.random.default_rng(5).uniform(-6, -1, len(number))
    want = []
    for a, z in zip(words.off[:-1].tolist(), words.off[1:].tolist()):
        tables, seen = ([collections.defaultdict(lambda x=x: x) for _ in range(3)] for x in (0.2, 1.5))
        weights = collections.defaultdict(lambda: [0.5, 0.5, 0.5])
        times = [number[a:i].tolist().count(number[i]) for i in range(a, z)]
        place = [min(15, int(math.log2(i + 1))) for i in range(z - a)]
        near = [(int(words.hash[a + i - 1]) >> 58 if a + i else 0, sum((times[i - k] > 0) << (k - 1) for k in (1, 2, 3) if i >= k), place[i]) for i in range(z - a)]
        for t in range(0, z - a, 8):
            w, now, errors, shares = weights[place[t]], range(t, min(t + 8, z - a)), [], []
            for i in now:
                x = [math.log(p[c] / (1 - p[c])) for p, c in zip(tables, near[i])]
                rate = min(max(1 / (1 + math.exp(-sum(map(float.__mul__, w, x)))), 1e-4), 1 - 1e-4)
                old, new = rate * times[i] / max(i, 1), (1 - rate) * 10 ** fresh[a + i]
                want.append(math.log10(old + new))
                shares.append(old / (old + new))
                errors.append([(shares[-1] - rate) * v for v in x])
            weights[place[t]] = [v + 0.02 * sum(e[k] for e in errors) for k, v in enumerate(w)]
            for k, (p, n) in enumerate(zip(tables, seen)):
                for i in now:
                    n[near[i][k]] += 1
                moves = [(near[i][k], (share - p[near[i][k]]) / min(n[near[i][k]], 60)) for i, share in zip(now, shares)]
                for c, move in moves:
                    p[c] += move
                for c, _ in moves:
                    p[c] = min(max(p[c], 0.002), 0.998)
    assert lm_score._mixed(words, number, fresh) == pytest.approx(want, abs=1e-9)


def test_code_shares_are_those_of_the_known_words():
    tokens, kinds = np.array([60, 40, 0]), np.array([9, 5, 0])
    rng = np.random.default_rng(4)
    split = lambda n: np.stack([np.bincount(rng.integers(0, 256, x), minlength=256) for x in n])
    m = lm_score.Model(np.zeros((3, 1)), tokens, tokens, 12, kinds=kinds, once=4, twice=2, single=6)
    m.code_tokens, m.code_kinds = split(tokens), split(kinds)
    left = np.where(tokens > 0, m.discount() * kinds / np.maximum(tokens, 1), 1)
    assert m.code_share().sum(1) == pytest.approx(1 - left * m.strange())


def test_lm_cost_of_long_unknown_words_has_no_floor(spark):
    r = random.Random(3)
    junk = "".join(r.choice("0123456789abcdef") for _ in range(20000))
    docs = frame(spark, [(i, prose(60, i)) for i in range(20)] + [(100, junk[:1000]), (101, junk[:20000]), (102, f"{junk[:1000]} {junk[:1000]}")])
    got = {x.doc_id: x.score for x in lm_score.scores(docs, F.col("doc_id") >= 100).collect() if x.held_out}
    assert got[100] < -600 and got[101] == pytest.approx(20 * got[100], rel=0.1)
    assert got[102] > 1.1 * got[100]  # said again, it is a repeat
    assert all(math.isfinite(x) for x in got.values())


# --- toxicity --------------------------------------------------------------


@pytest.fixture(scope="module")
def toxic_table():
    rng = random.Random(5)
    bad = ["wretch", "vermin", "cretin"]
    rows = []
    for i in range(500):
        text = prose(60, i).split()
        toxic = int(i % 5 == 0)
        if toxic:
            text[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(text), toxic))
    return rows


def test_toxicity_learns_and_restores(spark, toxic_table):
    docs = frame(spark, [(i, t) for i, t, _ in toxic_table] + [(900, None), (901, ""), (902, "you w r e t c h"), (903, "such v3rm1n here"), (904, "a cretiiiin"), (905, "cr.e.t.i.n"), (None, "vermin!"), (906, prose(5000, 1))])
    labels = spark.createDataFrame([(i, y) for i, _, y in toxic_table if i % 4] + [(901, None), (777, 1), (0, 1), (0, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in toxic_table)
    assert all(0 <= s <= 1 for s in got.values())
    assert got[900] == got[901] < 0.5 and got[906] < 0.5
    assert all(got[i] >= 0.5 for i in (902, 903, 904, None)), got
    kept = toxicity.reject(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < 0.5}


def suspicious(texts):
    data, offs = K.text_bytes(pa.array(texts, pa.string()))
    return toxicity._suspicious(data, offs).tolist()


def test_toxicity_restores_spelled_out_words_after_unbalanced_signs():
    assert suspicious(["hello!", "$5 $6", "f u c k", "plain words", "so!", "w r e t c h", "", None]) == [True, False, True, False, True, True, False, False]
    assert suspicious(["ab", "x y z", "a", "b c", "\u0e04\u0e04\u0e04", "\U00010400 \U00010401 \U00010402"]) == [False, True, False, False, True, True]


def test_toxicity_quick_look_leaves_out_nothing_that_the_pattern_matches():
    r = random.Random(7)
    for _ in range(300):
        texts = ["".join(r.choice("abc 12.-_*!$5@\u20ac\u00c4\u00e4\u043a\u0130\u03a3\n \u2014") for _ in range(r.randint(0, 14))) for _ in range(30)]
        assert not [t for t, yes in zip(texts, suspicious(texts)) if not yes and toxicity.DISGUISED.search(t.lower())]


def test_toxicity_without_labels_or_rows(spark):
    docs = frame(spark, [(1, "text"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    assert [r.score for r in toxicity.score(docs, model).collect()] == [pytest.approx(model.background)] * 2
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), none)).count() == 0


# --- pipeline --------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as P

    base, item = prose(120, 5), prose(20, 60)
    near = base.split()
    near[50] = "edit"
    clean = [(i, prose(70, 300 + i)) for i in range(40)]
    rows = [*clean, (50, base), (51, base.replace(" ", "  ", 4)), (52, " ".join(near)), (53, prose(30, 1) + " " + item + " " + prose(9, 61)), (54, prose(30, 2) + " " + item), (55, None), (56, "")]
    toxic = [(60 + i, prose(40, 500 + i) + " vermin") for i in range(12)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows + toxic], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 60)) for i, _ in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(9, 61))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    gone = []
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{sf}/stage{k}")
        after = spark.read.parquet(f"{sf}/stage{k}")
        gone.append({r.doc_id for r in docs.select("doc_id").exceptAll(after.select("doc_id")).collect()})
        docs = after
    assert gone == [{i for i, _ in toxic}, {51, 56}, {52}, {53, 54}]  # one item is enough
    pieces = P.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in pieces.collect()} == {r.doc_id for r in docs.collect()}
    assert P.run(spark, sf).count() == pieces.count()
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontaminate", "packing"]
