"""run() of the pipeline against plain code, on a small folder with awkward rows."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from riskweave.llm import mixing
from riskweave.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __hash string, __length int"


def folder(spark, docs, labels):
    path = scratch_path(spark, "pipeline-in")
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def grams(text):
    w = (text or "").split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_run_equals_plain_code(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    texts = []
    for k in range(30):
        base = rng.choices(words, k=rng.randint(30, 80))
        texts.append(" ".join(base))
        if k % 3 == 0:   # near copies
            texts += [" ".join([*base[:-1], rng.choice(words)]) for _ in range(2)]
    docs = [(k, t, "en", rng.choice(["a", "b", "b", "b", None]), len(t), "own", 5) for k, t in enumerate(texts)]
    docs += [docs[4], docs[4], (900, None, None, None, None, None, None), (901, "", "en", "a", 0, "x", 1), (None, "lone words without id", "en", "a", 21, None, None)]
    labels = [(k, 1, 0) for k in range(40)]   # one label alone: nothing is rejected
    path = folder(spark, docs, labels)

    # one document of each group of near copies: the smallest id
    ids = {k: t for k, t in enumerate(texts)}
    up = {k: k for k in ids}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    sets = {k: grams(t) for k, t in ids.items()}
    for a in ids:
        for b in ids:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    kept = [d for d in {d[:2]: d for d in docs}.values() if d[0] not in ids or root(d[0]) == d[0]]

    # the mix, by its stated properties on what is left
    size = {d[:2]: len((d[1] or "").split()) for d in kept}
    mixed = spark.createDataFrame(kept, DOCS)
    taken = {(r.doc_id, r.text): r.mix.taken for r in mixing.mix_sources(mixed).collect()}
    got = corpus_pipeline.run(spark, path).collect()
    times = Counter(r.doc_id for r in got)
    for d in kept:
        n = times.get(d[0], 0)
        assert n <= 3 and n * size[d[:2]] == taken[d[:2]]
    assert set(times) <= {d[0] for d in kept}

    # the encoding, by the library
    sentencepiece = pytest.importorskip("sentencepiece")
    import public_tokenizers
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    plain = {d[0]: [*model.encode(d[1] or ""), model.eos_id()] for d in kept}
    for r in got:
        want = plain[r.doc_id]
        assert list(r.ids) == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()


def test_stages_keep_columns_and_survive_empty_tables(spark):
    path = folder(spark, [(1, "a b c d e f", "en", "a", 11, "mine", 3), (2, None, None, None, None, None, None)], [(1, 1, 0)])
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns, name
        assert {(r["__hash"], r["__length"]) for r in out.collect() if r.doc_id == 1} <= {("mine", 3)}, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).count() == 0
