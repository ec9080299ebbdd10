"""Joins, searches, mixing, chats and the pipeline against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskweave.llm import chat, components, covertree, jaccard, mixing, topk
from riskweave.llm.streams import bounds, runs


def roots(vertices, edges):
    up = {v: v for v in vertices}

    def root(v):
        while up[v] != v:
            v = up[v]
        return v

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {v: root(v) for v in up}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300, k) for k in range(301, 400)] + [(k, k + 1) for k in range(500, 560)]
    frame = spark.createDataFrame(edges + edges[:9] + [(7, 7)], "a long, b long")
    got = {r.v: r.root for r in components.components(frame).collect()}
    assert got == {v: r for v, r in roots({x for e in edges for x in e if e[0] != e[1]}, edges).items()}
    assert components.components(frame.limit(0)).count() == 0


def test_runs_keep_groups_whole():
    import pyarrow as pa
    keys = np.repeat(np.arange(40), np.random.default_rng(1).integers(1, 30, 40))
    table = pa.table({"k": keys, "v": np.arange(len(keys))})
    seen = []
    for t in runs(iter(table.to_batches(max_chunksize=7)), 1):
        cuts = bounds(t, 1)
        seen += [tuple(t.column(1).to_pylist()[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
    assert seen == [tuple(np.flatnonzero(keys == k)) for k in range(40)]


# --- n-gram join -------------------------------------------------------------------------

def near_texts(rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    shared = " ".join(word() for _ in range(12))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy) + (" " + shared if rng.random() < 0.5 else ""))
    hot = [word() for _ in range(60)]
    for _ in range(90):  # a large group of near copies
        copy = list(hot)
        copy[rng.randrange(60)] = word()
        texts.append("\t".join(copy))
    return texts + ["one two", "one two", "one", "", "", None, " \n", "a b c d e", "a b c d e", " ".join(hot)] + [texts[0]] * 40


def test_join_equals_brute_force(spark):
    texts = near_texts(random.Random(4))
    frame = spark.createDataFrame([(k + 5, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, class_id string")
    got = {r.doc_id: (r.n_links, r.class_id, r.kept) for r in jaccard.similarity_join(
        frame, small=16, block_sets=20).collect()}
    sets = {}
    for k, t in enumerate(texts):
        w = [x for x in re.split(r"[ \t\n\x0b\x0c\r]+", t or "") if x]
        sets[k + 5] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b]
             and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    count, root = Counter(x for e in links for x in e), roots(sets, links)
    assert got == {k: (count[k], root[k], root[k] == k) for k in sets}


def test_join_of_odd_rows(spark):
    rows = [(None, "a b c d e f", "x"), (None, "a b c d e f", "x"), (3, "a b c d e f", "y"), (3, "a b c d e f", "y"), (9, None, "z"), (None, None, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, set_key string")
    got = sorted(((r.doc_id, r.n_links, r.class_id, r.kept) for r in jaccard.similarity_join(frame).collect()), key=str)
    assert got == sorted([(None, 3, 3, False)] * 2 + [(3, 3, 3, True)] * 2 + [(9, 0, 9, True), (None, 0, None, True)], key=str)
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted(kept.select("doc_id", "text").collect(), key=str) == sorted([(3, "a b c d e f"), (9, None), (None, None)], key=str)
    assert jaccard.similarity_join(frame.limit(0)).count() == 0


def test_trees_reach_the_recall():
    n = jaccard.trees_for(0.99, 0.8, 3)
    rng, found = np.random.default_rng(5), 0
    for trial in range(300):
        sig = rng.integers(0, 1 << 30, (2, 64)).astype(np.int32)
        sig[1, :51] = sig[0, :51]
        paths = [set(jaccard.mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(1000 * trial)).tolist())] * 2
        for _ in range(3):
            paths = [set(jaccard._children(np.array(sorted(p), np.uint64), np.repeat(sig[k:k + 1], len(p), 0), 0.8)[1].tolist())
                     for k, p in enumerate(paths)]
            paths = [paths[0] & paths[1]] * 2
            if not paths[0]:
                break
        found += bool(paths[0])
    assert found / 300 > 0.97


# --- mixing ------------------------------------------------------------------------------

def best_sum(items, budget):
    reach = {0}
    for n in items:
        reach |= {s + n for s in reach if s + n <= budget}
    return max(reach)


def test_budget_fit_equals_subset_sums():
    rng = random.Random(6)
    for _ in range(300):
        lengths = rng.sample(range(1, 60), rng.randint(1, 6))
        counts = [rng.randint(0, 5) for _ in lengths]
        budget = rng.randint(0, 300)
        take = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts))
        # The proportional first step is fixed; what is left is fitted exactly.
        total = sum(n * c for n, c in zip(lengths, counts))
        base = [c * min(budget, total) // total if total else 0 for c in counts]
        left = [n for n, c, b in zip(lengths, counts, base) for _ in range(c - b)]
        rest = min(budget, total) - sum(n * b for n, b in zip(lengths, base))
        assert sum(n * t for n, t in zip(lengths, take)) == sum(n * b for n, b in zip(lengths, base)) + best_sum(left, rest)


def shares(sizes, weights, total, cap):
    target, free = {}, set(sizes)
    while free:
        level = (total - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * level > cap * sizes[s]}
        for s in over or free:
            target[s] = cap * sizes[s] if over else weights[s] * level
        free -= over or set(free)
    return target


def test_mix(spark):
    rng = random.Random(8)
    rows = []
    for source, n in (("b", 400), ("a", 30), ("é", 3), (None, 200), ("c", 90), ("empty", 2)):
        for _ in range(n):
            rows.append((len(rows), " ".join("w" * rng.randint(1, 3) for _ in range(0 if source == "empty" else rng.randint(0, 40))) or None, source, 0))
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix_sources(frame).select("doc_id", "source", "mix.*").collect()
    again = mixing.mix_sources(frame.repartition(7)).select("doc_id", "source", "mix.*").collect()
    assert sorted(got, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)
    sizes = defaultdict(int)
    for r in got:
        assert r.size == len((rows[r.doc_id][1] or "").split()) and r.taken == r.size * r.repeats and 0 <= r.repeats <= 3
        sizes[r.source] += r.size
    order = sorted(sizes, key=lambda s: (s is None, s and s.encode()))
    target = shares(sizes, {s: 1 + k % 3 for k, s in enumerate(order)}, sum(sizes.values()), 3)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 3 for s in sizes)
    out = mixing.mixed_rows(frame)
    assert out.columns == frame.columns and out.count() == sum(r.repeats for r in got)
    assert mixing.mix_sources(frame.limit(0)).count() == 0
    same = spark.createDataFrame([(None, "a b", "s")] * 7 + [(1, "a b", "t")] * 3, "doc_id long, text string, source string")
    assert mixing.mix_sources(same).select(F.sum("mix.taken")).first()[0] in range(18, 22)


def test_rows_are_not_ordered(spark):
    rng = random.Random(9)
    rows = [(k, "w " * rng.randint(0, 9), rng.choice("abc")) for k in range(500)]
    out = mixing.mixed_rows(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan and plan.count("Join") == 1


def test_copies_at_a_border_are_numbered_by_spans(spark):
    rng = random.Random(10)
    take = {("a", 3): 40, (None, 3): 1, ("a", 4): 99}
    rows = [(*key, take[key], row) for row in range(0, 1000, 3) for key in [rng.choice(list(take))]]
    frame = spark.createDataFrame(rows, "__s string, __z long, __m long, __row long").withColumn("__more", F.lit(None).cast("int"))
    got = mixing._number(frame, spans=50).collect()
    assert len(got) == len(rows) and Counter((r["__s"], r["__z"]) for r in got if r["__more"]) == take


# --- chats -------------------------------------------------------------------------------

def test_chats_round_trip(spark):
    rng = random.Random(3)
    bits = ["<|", "|>", "<|sep|>", "<|end|>", "<|@user|>", "\\", "\\\\", "<", "|", "[INST]", "</s>", "<<SYS>>", "<s>", "é", "😀", "\n", "x", ""]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant", "assistant", "sep", "we|>ird", None])
            rows.append((conv if conv else None, turn if turn else None, role, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) or None))
    rows += [(7, 3, "assistant", "twice")] * 2 + [(500, k, "assistant", "long " * 200) for k in range(300)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, messages string")
    chats = chat.format_chats(frame)
    got = {r.conv_id: tuple(r)[1:] for r in chat.digests(chats).collect()}
    turns = defaultdict(list)
    for c, t, r, x in rows:
        turns[c].append((t is not None, t or 0, r or "", x or ""))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, found in turns.items():
        found.sort()
        loss = "".join(x for _, _, r, x in found if r == "assistant")
        assert got[c][:4] == (len(found), sha("".join(f"{r}\n{x}\n" for _, _, r, x in found)), len(loss), sha(loss))
    for r in chats.collect():
        bare = re.sub(r"<\|(@(?:\\.|[^|]|\|(?!>))*|sep|end)\|>", "", r.formatted)
        assert not re.search(r"<\||\|>|</|<s|<<|\[I|\[/", re.sub(r"<(?=$)", "", bare)) or "<" in bare
        assert sum(s.length for s in r.loss_spans) <= len(r.formatted)
    assert chat.digests(chat.format_chats(frame.limit(0))).count() == 0


# --- vectors -----------------------------------------------------------------------------

def vector_rows(seed, n=420, dim=8):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        v = rng.normal(size=dim) * rng.choice([0.2, 1, 3])
        if k % 7 == 0 and rows and rows[-1][1] is not None:
            v = np.array(rows[-1][1]) * rng.choice([1, 2]) + rng.normal(size=dim) * 0.01
        rows.append((k, v.tolist(), int(rng.integers(0, 3))))
    rows += [(n + k, rows[5][1], 1) for k in range(60)]                     # a hot vector
    rows += [(1000, None, 1), (1001, [1.0, None], 1), (1020, [float("nan")] * dim, 1), (1040, [float("inf")] * dim, 1),
             (1060, [0.0] * dim, 1), (1061, [], 1), (1080, [1.0, 2.0], 1), (1081, [1.0, 2.0], 1), (1100, rows[0][1], None)]
    return rows


def take_part(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("bucket,block", [(4096, 2048), (50, 5)])
def test_top_products(spark, bucket, block):
    rows = vector_rows(1)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, score string")
    got = sorted(tuple(r) for r in topk.top_products(frame, bucket=bucket, block=block).collect())
    assert got == sorted(plain_products(rows))
    assert topk.top_products(frame.limit(0)).count() == 0


LIMIT = 2 ** 63 - 1  # larger scores count as this


def plain_products(rows):
    z = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if take_part(v)]
    for at, (q, u) in enumerate(z):
        if q is not None and q % 20 == 0:
            found = sorted((-max(-LIMIT, min(LIMIT, sum(a * b for a, b in zip(u, w)))), c is None, c or 0) for k, (c, w) in enumerate(z)
                           if k != at and len(w) == len(u))[:20]
            yield from ((q, k + 1, None if null else c, -s) for k, (s, null, c) in enumerate(found))


@pytest.mark.parametrize("bucket,block", [(4096, 2048), (30, 5)])
def test_products_of_repeated_and_null_ids_and_large_numbers(spark, bucket, block):
    rng = random.Random(12)
    rows = [(rng.choice([None, 0, 7, 20, 40, 41]), [rng.choice([-2.5, 0.1, 1.0, 9.0]) for _ in range(3)]) for _ in range(200)]
    rows += [(20, [1.0, 1.0, 1.0])] * 30 + [(7, [9.0, 9.0, 9.0]), (7, [0.1, 0.1, 0.1])]
    rows += [(60, [1e9, 2.0]), (61, [1e-3, 5.0]), (62, [-1e6, 3.5]), (80, [1e7 + 0.125, 1e-2]), (81, [1e7, 0.5]), (82, [1e7 + 1 / 64, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_products(frame, bucket=bucket, block=block).collect()]
    assert Counter(got) == Counter(plain_products(rows))


@pytest.mark.parametrize("block", [4096, 40])
def test_near_duplicate_vectors(spark, block):
    rows = vector_rows(2)
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, point string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(frame, block=block).collect()}
    live = [(i, np.array(v), y) for i, v, y in rows if take_part(v) and any(v) and y is not None]
    links = [(a, b) for a, u, y in live for b, v, z in live if a < b and y == z and len(u) == len(v)
             and u @ v / (np.sqrt(u @ u) * np.sqrt(v @ v)) >= 0.98]
    count, root = Counter(x for e in links for x in e), roots([r[0] for r in rows], links)
    assert got == {i: (count[i], root[i], root[i] == i) for i, _, _ in rows}
    assert covertree.near_duplicates(frame.limit(0)).count() == 0


def test_cover_tree_levels():
    x = np.random.default_rng(3).normal(size=(300, 5))
    x /= np.sqrt((x * x).sum(1))[:, None]
    tree, radius = covertree.CoverTree(x, 0.1), 2.0
    for level, below in enumerate(tree.children):
        radius /= 2
        for centre, children in below.items():
            assert centre in children                                     # nested
            apart = covertree._distance(x[children], x[children]) + np.eye(len(children)) * 9
            assert apart.min() > radius - 1e-6 or len(children) == 1       # separated
    assert sorted(np.concatenate(list(tree.leaves.values()))) == list(range(300))


# --- the pipeline ------------------------------------------------------------------------

def test_pipeline_stages(spark):
    import corpus_pipeline as p
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, before, base).collect(), docs.schema)
        assert docs.columns == columns
        if name == "quality":
            labels = spark.read.parquet(f"{base}/labels.parquet")
            good = before.join(labels.where("quality = 1"), "doc_id")
            assert docs.join(good, "doc_id", "left_semi").count() >= 0.9 * good.count()
        if name == "jaccard":
            kept = {r.doc_id for r in docs.collect()}
            expected = {r.doc_id for r in jaccard.similarity_join(before).collect() if r.kept}
            assert kept == expected and len(kept) == docs.count()
        if name == "secrets":
            assert docs.count() == before.count()
            assert docs.where('text rlike \'token = "[0-9a-f]{40}\'').count() == 0
            assert docs.where("n_chars != length(text)").count() == 0
        if name == "mixing":
            taken = {r.doc_id: r.mix.repeats for r in mixing.mix_sources(before).collect()}
            assert Counter(r.doc_id for r in docs.collect()) == {k: n for k, n in taken.items() if n}
    out = p.STAGES[-1][1](spark, docs, base)
    assert out.count() == docs.count() and "ids_sha256" in out.columns
