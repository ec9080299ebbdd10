"""Phrases, benchmark windows and vector codes against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskweave.llm import bitmaps, codes, decontaminate, phrases, wordstream

LOWER = {k: k + 32 for k in range(65, 91)}


# --- words as arrays -----------------------------------------------------------------

@pytest.mark.parametrize("size", [7, 64, 1 << 20])
@pytest.mark.parametrize("kinds, pattern", [(phrases.KINDS, r"[^ \t.,;:!?\n\x0b\x0c\r]+"), (
    decontaminate.KINDS, "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")])
def test_parts_hold_each_word_once(size, kinds, pattern):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aB9é漢 .\n\t-") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", "x" * 50, "." * 50, "ab cd " * 30, ""]
    got = defaultdict(list)
    for p in wordstream.parts(pa.array(texts), kinds, 3, size):
        spelled = p.words.take(pa.array(p.codes)).to_pylist()
        ahead = spelled[p.own:]
        for row, w in zip(p.row[:p.own], spelled):
            got[row].append(w)
        rest = re.findall(pattern, (texts[p.rows.start] or "").translate(LOWER))[len(got[p.rows.start]):]
        assert ahead == ([] if p.last else rest[:len(ahead)]) and (p.last or len(ahead) == min(3, len(rest)))
    assert [got[k] for k in range(len(texts))] == [re.findall(pattern, (t or "").translate(LOWER)) for t in texts]


def test_word_hashes_follow_the_letters_alone():
    words = pa.array(["a", "ab", "ba", "é", "a" * 70000, "a" * 70001])
    whole = wordstream.hash_words(words)
    assert len(set(whole.tolist())) == len(words)
    assert wordstream.hash_words(words.slice(2, 2)).tolist() == whole[2:4].tolist()
    assert len(wordstream.hash_words(pa.array([], pa.string()))) == 0


def test_bitmap(spark):
    at = [0, 1, 32767, 32768, 65535, (1 << 17) - 1]
    bits = bitmaps.collect_bits(spark.createDataFrame([(a,) for a in at * 3], "h long"), F.col("h"), 17)
    assert np.flatnonzero(bitmaps.holds(bits, np.arange(1 << 17))).tolist() == at
    assert not bitmaps.collect_bits(spark.range(0), F.col("id"), 3).any()


# --- phrases ---------------------------------------------------------------------------

def plain_phrases(rows, top=2000, support=10, longest=3, held=50):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang in f:
        found = {p: c for p, c in f[lang].items() if len(p) > 1 and c >= support}
        kept = []
        for p, a in found.items():
            if any(100 * c >= held * a and len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, c in found.items()):
                continue
            score, _, left, right = min((1000000 * a * a // (f[lang][p[:k]] * f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]])
                                        for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -score)
                for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def phrase_rows(rng):
    word = ["ab", "Ab", "é", "ÉÉ", "c", "c\x1f", "x-y", "　", "dd", "e", "漢"]
    rows = [(" ".join(rng.choices(word, k=rng.randint(0, 90))).replace("dd e", "dd. e").replace("c c", rng.choice(["c\tc", "c  c", "c!c"])),
             rng.choice(["en", "en", "en", None, "und", ""])) for _ in range(150)]
    return rows + [(None, "en"), ("", None), (" .\n", "zz"), ("solo", "qq")] + [("fox trot now. fox trot", "en")] * 60


@pytest.mark.parametrize("shards, longest, top", [(3, 3, 2000), (1, 2, 5), (5, 4, 30)])
def test_phrases_equal_brute_force(spark, monkeypatch, shards, longest, top):
    rows = phrase_rows(random.Random(3))
    frame = spark.createDataFrame([(t, g, 1, "x", 2.0) for t, g in rows], "text string, lang string, f int, phrase string, score double")
    monkeypatch.setattr(phrases, "HELD", 500)
    got = phrases.collocations(frame.repartition(5), shards=shards, longest=longest, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, top=top, longest=longest)


def test_long_text_and_empty_table(spark, monkeypatch):
    text = " ".join(random.Random(1).choices(["a", "b", "c", "d."], k=6000))
    frame = spark.createDataFrame([(text, "en"), (text, "en")], "text string, lang string")
    plain = plain_phrases([(text, "en")] * 2)
    small = lambda texts, kinds, ahead=0, size=0, whole=wordstream.parts: whole(texts, kinds, ahead, 700)
    got = phrases.collocations(frame)
    assert sorted(map(tuple, got.collect())) == plain
    cut = [tuple(p.words.take(pa.array(p.codes[:p.own])).to_pylist()) for p in small(pa.array([text]), phrases.KINDS, 2)]
    assert len(cut) > 10 and sum(map(len, cut)) == 6000
    assert phrases.collocations(frame.limit(0)).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", 0, "", 10 ** 13), ("en", 1, "a", 3_000_000_007), ("en", 1, "b", 3_000_000_011), ("en", 2, "a b", 2_999_999_999)],
        "lang string, words int, phrase string, f long")
    original = phrases.phrase_counts
    phrases.phrase_counts = lambda docs, **kw: docs
    try:
        got = phrases.collocations(counts).collect()
    finally:
        phrases.phrase_counts = original
    assert [r.score for r in got] == [10 ** 6 * 2_999_999_999 ** 2 // (3_000_000_007 * 3_000_000_011)]


# --- benchmark windows -----------------------------------------------------------------

def plain_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


def plain_hits(text, bench, window=10):
    w, marks, items = plain_words(text), set(), set()
    for item, t in bench:
        b = plain_words(t)
        m = min(window, len(b))
        wins = {tuple(b[i:i + m]) for i in range(len(b) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i:i + m]) in wins:
                marks.update(range(i, i + m))
                items.add(item)
    return len(w), marks, sorted(items - {None})


def bench_rows(rng):
    words = ["ab", "Cd", "é1", "9", "x", "yy", "漢"]
    text = lambda n: rng.choice([" ", "--", ".\n"]).join(rng.choices(words, k=n))
    bench = [(k, text(rng.randint(10, 30))) for k in range(6)] + [(6, "yy ab"), (6, "x 9 X"), (7, ""), (8, None), (None, "9 9 9 9")]
    docs = []
    for k in range(60):
        got = text(rng.randint(0, 40))
        if rng.random() < 0.5:
            b = bench[rng.randrange(6)][1]
            got += rng.choice([" ", "", ".. "]) + b.upper()[:rng.randint(0, len(b))] + " " + text(rng.randint(0, 12))
        docs.append(got)
    docs += [None, "", "-- .", bench[2][1] * 3, "é" * 300, bench[0][1], bench[0][1]]
    return bench, docs


def check_hits(got, docs, bench):
    for r in got:
        n, marks, items = plain_hits(docs[r.doc_id], bench)
        seen = [w for run in r.hits.runs for w in range(run.first, run.last)]
        assert (r.hits.n_words, seen, sorted(r.hits["items"])) == (n, sorted(marks), items), r
        words = plain_words(docs[r.doc_id])
        for run in r.hits.runs:
            assert plain_words(docs[r.doc_id][run.start:run.end]) == words[run.first:run.last]


@pytest.mark.parametrize("block_bytes", [1 << 20, 3000])
def test_hits_equal_brute_force(spark, block_bytes):
    bench, docs = bench_rows(random.Random(8))
    frame = spark.createDataFrame([(k, t, "h") for k, t in enumerate(docs)], "doc_id long, text string, item string")
    items = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, hits int")
    got = decontaminate.find_hits(frame, items, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "text", "item", "hits"]
    check_hits(got.collect(), docs, bench)


def test_long_text_is_scanned_in_stretches(monkeypatch):
    bench, docs = bench_rows(random.Random(9))
    docs += [" ".join(d or "" for d in docs) + " é " + docs[3]]
    found = [(n, h, " ".join(w[i:i + n]), item) for item, t in bench for w in [plain_words(t)] if w for n in [min(10, len(w))]
             for i in range(len(w) - n + 1) for h in [0]]
    phrase = [f[2] for f in found]
    hashes = [int(decontaminate._window_hashes(wordstream.hash_words(pa.array(p.split(" "))), n)[0]) for p, (n, *_) in zip(phrase, found)]
    block = decontaminate.Block(pa.table({"words": [f[0] for f in found], "h": pa.array(np.array(hashes, np.uint64).view(np.int64)),
                                          "phrase": phrase, "item": pa.array([f[3] for f in found], pa.int64())}))
    whole = decontaminate._scan(pa.array(docs), block, 10)
    monkeypatch.setattr(decontaminate, "parts", lambda t, k, a: wordstream.parts(t, k, a, 61))
    cut = decontaminate._scan(pa.array(docs), block, 10)
    for a, b in zip(whole, cut):
        assert np.array_equal(a, b)
    marked = defaultdict(set)
    for row, place, *_ in whole[1]:
        marked[row].add(place)
    assert [marked[k] for k in range(len(docs))] == [plain_hits(t, bench)[1] for t in docs]


def test_hash_alone_is_no_hit(monkeypatch):
    monkeypatch.setattr(decontaminate, "_window_hashes", lambda h, n: np.zeros(max(0, len(h) - n + 1), np.uint64))
    block = decontaminate.Block(pa.table({"words": pa.array([2, 2], pa.int32()), "h": pa.array([0, 0]), "phrase": ["a b", "b c"], "item": pa.array([1, 2])}))
    total, hits, pairs = decontaminate._scan(pa.array(["x y a b b d", "b a c"]), block, 10)
    assert hits[:, :2].tolist() == [[0, 2], [0, 3]] and pairs.tolist() == [[0, 0]]


def test_spans_and_documents_are_removed(spark):
    bench = spark.createDataFrame([(1, "one Two three"), (2, "vier")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "é one, two: three! 漢 VIER", 5), (1, "clean one two", 6), (2, None, 7), (3, "vier", 8)], "doc_id long, text string, hits int")
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench).collect()}
    assert spans == {0: "é ! 漢 ", 1: "clean one two", 2: None, 3: ""}
    kept = decontaminate.decontaminate(docs, bench, remove="documents")
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2]
    assert decontaminate.decontaminate(docs, bench.limit(0), remove="documents").count() == 4
    assert decontaminate.find_hits(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, bench, remove="all")


# --- codes -----------------------------------------------------------------------------

def plain_codes(rows, entries=16, rounds=6):
    kept = [(i, [math.floor(4096 * v) for v in x], g) for i, x, g in rows
            if x and all(v is not None and math.isfinite(v) for v in x)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = len(kept[0][1]) // 8
    cut = lambda x, p: x[p * wide:(p + 1) * wide]
    far = lambda x, z: sum((a - b) ** 2 for a, b in zip(x, z))
    books = [[cut(x, p) for _, x, _ in kept[:entries]] for p in range(8)]
    near = lambda x, book: min(range(len(book)), key=lambda e: (far(x, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = defaultdict(list)
            for _, x, _ in kept:
                of[near(cut(x, p), book)].append(cut(x, p))
            books[p] = [[sum(c) // len(c) for c in zip(*of[e])] if of[e] else z for e, z in enumerate(book)]
    out, total = [], Counter()
    for i, x, g in kept:
        code = [near(cut(x, p), books[p]) for p in range(8)]
        error = sum(far(cut(x, p), books[p][e]) for p, e in enumerate(code))
        total[g] += error
        out.append((i, "".join(f"{e:02x}" for e in code), error, g))
    digest = hashlib.sha256(",".join(str(v) for b in books for z in b for v in z).encode()).hexdigest()
    return Counter((i, code, error, total[g], digest) for i, code, error, g in out)


def vector_rows(rng, n, scale=1.0, width=16):
    rows = [(rng.randrange(10 * n), [rng.choice([-1, 0, 0.5, 1]) * scale * rng.choice([1, 1, rng.random()]) for _ in range(width)],
             rng.choice([0, 1, 1, 1, None])) for _ in range(n)]
    rows += rows[:7] + [(rows[0][0], rows[5][1], 1), (None, rows[3][1], 0)]
    return rows + [(1, None, 0), (2, [], 1), (3, [None] * width, 1), (4, [math.nan] * width, 1), (5, [math.inf] * width, 0)]


@pytest.mark.parametrize("n, scale", [(150, 1.0), (6, 3.0), (40, 1e9)])
def test_codes_equal_brute_force(spark, n, scale):
    rows = vector_rows(random.Random(n), n, scale)
    frame = spark.createDataFrame([(i, x, g, "x", 1) for i, x, g in rows],
                                  "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)
    got = codes.compress(frame)
    assert got.columns == ["id", "code", "error", "label_error", "codebooks_sha256"]
    plain = plain_codes(rows)
    if scale > 1e6:  # sums of squares that pass 64 bits are null
        fits = lambda v: v if v is not None and v < 1 << 63 else None
        bad = {k for k in plain if k[2] >= 1 << 63}
        assert bad or max(k[3] for k in plain) < 1 << 63
        plain = Counter({(i, c, fits(e), fits(t), d): m for (i, c, e, t, d), m in plain.items()})
    assert Counter(map(tuple, got.collect())) == plain


def test_candidates_hold_the_nearest_and_drop_the_rest():
    rng = np.random.default_rng(2)
    book = codes.Codebook(rng.integers(-4000, 4000, (64, 6)).tolist())
    x = rng.integers(-5000, 5000, (500, 6))
    far = ((x[:, None] - np.array(book.rows)[None]) ** 2).sum(2)
    for kind in (np.int64, object):
        best, least, mask = book.search(x.astype(kind))
        assert (best == far.argmin(1)).all() and (least == far.min(1)).all()
        assert np.bitwise_count(mask).mean() < 32


def test_codes_of_nothing_and_odd_lengths(spark):
    frame = spark.createDataFrame([(1, [1.0] * 12, 0), (2, [1.0] * 8, 0), (3, [2.0] * 8, 0), (4, [2.0] * 16, 0), (5, [2.0 ** 50] + [0.0] * 7, 0)],
                                  "vec_id long, embedding array<double>, label int")
    assert sorted(r.id for r in codes.compress(frame).collect()) == [2, 3]
    assert codes.compress(frame.limit(0)).count() == 0
    assert codes.compress(frame.where("vec_id = 1")).count() == 0


def test_decoded_vectors_are_near(spark):
    rows = vector_rows(random.Random(4), 80)[:80]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    books = codes.fit_codebooks(frame)
    coded = codes.decode(codes.encode(frame, books), books).collect()
    for r in coded:
        error = sum((math.floor(4096 * a) - 4096 * b) ** 2 for a, b in zip(r.embedding, r.approximate))
        assert round(error) == r.coded.error
