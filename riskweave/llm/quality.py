"""Operator 9: quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage of the whole text is encoded from
its counts of neighbouring character classes and repeated words; a small network turns it into a
vector, gated attention weighs the vectors of a document, and the weighted vector is
scored.  Only documents carry labels, so encoder, attention and scorer are learned
together from them.

The network is fitted on the driver from a bounded sample of labelled documents
(``per_class`` documents of each label, ``per_doc`` passages of each, both chosen by
a hash); scoring reads every passage of every text inside the tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 640          # bytes of UTF-8
PER_CLASS = 2000       # labelled documents of each label that a fit reads at most
PER_DOC = 32           # passages of one of those documents at most
BLOCK = 1024           # passages that are scored at once
THRESHOLD = 0.7


def _classes() -> tuple[np.ndarray, int]:
    """Class of each byte: vowels, consonants, capitals, digits, blank, line feed, each
    group of signs, lead and continuation bytes of longer characters."""
    groups = ["aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "0123456789",
              " ", "\n", "\t\r\x0b\x0c", ".", ",", "!?", ";:", "'\"`", "-_", "()[]{}<>", "|/\\",
              "#$%&", "*+=~^@"]
    table = np.full(256, len(groups), np.uint16)
    for k, chars in enumerate(groups):
        for c in chars:
            table[ord(c)] = k
    table[128:192] = len(groups) + 1
    table[192:] = len(groups) + 2
    return table, len(groups) + 3


TABLE, N_CLASSES = _classes()
PAIRS = N_CLASSES * N_CLASSES
WIDTH = PAIRS + 2
BREAK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
SIGN = np.random.default_rng(11).integers(1, 1 << 40, 256)  # a word's sign is the sum of its bytes'


def passage_counts(data: np.ndarray) -> np.ndarray:
    """Counts of neighbouring classes for each passage of a text in UTF-8, then the
    thousandths of its words that equal the word before and that are new in the
    passage; an empty text is one passage of zeros."""
    n = max(1, -(-len(data) // PASSAGE))
    out = np.zeros((n, WIDTH), np.uint16)
    if len(data) < 2:
        return out
    kind = TABLE[data].astype(np.int64)
    pairs = kind[:-1] * N_CLASSES + kind[1:]
    pairs += (np.arange(len(pairs)) // PASSAGE) * PAIRS
    out[:, :PAIRS] = np.bincount(pairs, minlength=n * PAIRS)[:n * PAIRS].reshape(n, PAIRS)
    ends = np.append(np.flatnonzero(BREAK[data]), len(data))
    starts = np.append(0, ends[:-1] + 1)
    total = np.append(0, np.cumsum(SIGN[data]))
    sign = (total[ends] - total[starts]) & 0xFFFFFFFF
    sign, at = sign[ends > starts], starts[ends > starts] // PASSAGE
    if len(sign):
        words = np.maximum(np.bincount(at, minlength=n), 1)
        again = np.bincount(at[1:][sign[1:] == sign[:-1]], minlength=n)
        new = np.bincount(np.unique(at << 32 | sign) >> 32, minlength=n)
        out[:, PAIRS], out[:, PAIRS + 1] = 1000 * again // words, 1000 * new // words
    return out


def passage_blocks(data: np.ndarray, passages: int = BLOCK) -> Iterator[np.ndarray]:
    """What passage_counts gives, a bounded number of passages at a time."""
    size = passages * PASSAGE
    if len(data) <= size:
        yield passage_counts(data)
        return
    before = None  # sign of the last word
    for at in range(0, len(data), size):
        stop = min(at + size, len(data))
        n = -(-(stop - at) // PASSAGE)
        out = np.zeros((n, WIDTH), np.uint16)
        kind = TABLE[data[at:stop + 1]].astype(np.int64)
        pairs = kind[:-1] * N_CLASSES + kind[1:] + (np.arange(len(kind) - 1) // PASSAGE) * PAIRS
        out[:, :PAIRS] = np.bincount(pairs, minlength=n * PAIRS)[:n * PAIRS].reshape(n, PAIRS)
        # words that begin in the block, the last one up to its end
        first = at if at == 0 or BREAK[data[at - 1]] else _next_break(data, at)
        last = stop if stop == len(data) or BREAK[data[stop - 1]] else _next_break(data, stop)
        if first < stop:
            part = data[first:last]
            ends = np.append(np.flatnonzero(BREAK[part]), len(part))
            starts = np.append(0, ends[:-1] + 1)
            total = np.append(0, np.cumsum(SIGN[part]))
            sign = (total[ends] - total[starts]) & 0xFFFFFFFF
            sign, place = sign[ends > starts], (starts[ends > starts] + first - at) // PASSAGE
            if len(sign):
                words = np.maximum(np.bincount(place, minlength=n), 1)
                same = np.append(before is not None and sign[0] == before, sign[1:] == sign[:-1])
                out[:, PAIRS] = 1000 * np.bincount(place[same], minlength=n) // words
                out[:, PAIRS + 1] = 1000 * np.bincount(np.unique(place << 32 | sign) >> 32, minlength=n) // words
                before = sign[-1]
        yield out


def _next_break(data: np.ndarray, at: int) -> int:
    while at < len(data):
        found = np.flatnonzero(BREAK[data[at:at + 65536]])
        if len(found):
            return at + int(found[0])
        at += 65536
    return len(data)


def encode(counts: np.ndarray) -> np.ndarray:
    """Roots of the shares, so that rare neighbours still weigh something."""
    x = counts.astype(np.float32)
    x[:, :PAIRS] /= np.maximum(x[:, :PAIRS].sum(1, keepdims=True), 1)
    x[:, PAIRS:] /= 1000
    return np.sqrt(x)


@dataclass
class Model:
    """Weights of the network; ``prior`` alone is used where no fit was possible."""

    weights: dict[str, np.ndarray]
    prior: float | None = None

    def scores(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Score of each bag; ``starts`` are the first rows of the bags in ``x``."""
        if self.prior is not None:
            return np.full(len(starts), self.prior)
        return _forward(self.weights, x, starts)["score"]

    def score_blocks(self, blocks: Iterator[np.ndarray]) -> float:
        """Score of one bag that comes in blocks: the attention is kept as its largest
        exponent, the sum of the weights and the weighted sum."""
        if self.prior is not None:
            return self.prior
        w, most, total, z = self.weights, -np.inf, 0.0, 0.0
        for x in blocks:
            h, e = _attention(w, x)[:2]
            now = max(most, e.max())
            a = np.exp(e - now)
            total, z, most = total * np.exp(most - now) + a.sum(), z * np.exp(most - now) + a @ h, now
        return float(1 / (1 + np.exp(-(z / total @ w["c"] + w["d"]))))


def _attention(w, x):
    h = np.tanh(x @ w["W"] + w["b"])
    t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
    return h, (t * g) @ w["a"], t, g


def _forward(w, x, starts):
    sizes = np.diff(np.append(starts, len(x)))
    bag = np.repeat(np.arange(len(starts)), sizes)
    h, e, t, g = _attention(w, x)
    e = np.exp(e - np.maximum.reduceat(e, starts)[bag])
    a = e / np.add.reduceat(e, starts)[bag]
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    score = 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))
    return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "score": score}


def _gradients(w, x, starts, y, weight):
    f = _forward(w, x, starts)
    bag, h, t, g, a = f["bag"], f["h"], f["t"], f["g"], f["a"]
    ds = ((f["score"] - y) * weight / weight.sum()).astype(np.float32)
    out = {"c": f["z"].T @ ds, "d": ds.sum()}
    dz = ds[:, None] * w["c"]
    dh = a[:, None] * dz[bag]
    da = (dz[bag] * h).sum(1)
    de = a * (da - np.add.reduceat(a * da, starts)[bag])
    out["a"] = (t * g).T @ de
    dtg = de[:, None] * w["a"]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    out["V"], out["U"] = h.T @ dt, h.T @ dg
    dh += dt @ w["V"].T + dg @ w["U"].T
    dh *= 1 - h * h
    out["W"], out["b"] = x.T @ dh, dh.sum(0)
    return out


def train(x: np.ndarray, starts: np.ndarray, y: np.ndarray, *, width: int = 24, gate: int = 12,
          epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4,
          seed: int = 7) -> Model:
    """Fit the network by Adam on bags with labels; both labels weigh the same."""
    if len(y) == 0 or y.min() == y.max():
        return Model({}, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    normal = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    w = {"W": normal(x.shape[1], width) * 3, "b": np.zeros(width, np.float32), "V": normal(width, gate),
         "U": normal(width, gate), "a": normal(gate), "c": normal(width), "d": np.float32(0)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    ends = np.append(starts, len(x))[1:]
    weight = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y <= 0).mean()).astype(np.float32)
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(order), batch):
            chosen = order[k:k + batch]
            rows = np.concatenate([np.arange(starts[i], ends[i]) for i in chosen])
            sizes = ends[chosen] - starts[chosen]
            grads = _gradients(w, x[rows], np.append(0, np.cumsum(sizes)[:-1]), y[chosen], weight[chosen])
            step += 1
            for name, g in grads.items():
                g = g + decay * w[name]
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                w[name] = (w[name] - rate * (first[name] / (1 - 0.9 ** step))
                           / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return Model(w)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels no fit may read."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id",
        label: str = "quality", per_class: int = PER_CLASS, per_doc: int = PER_DOC) -> Model:
    """Fit on a bounded sample of the labelled documents that are not held out.

    Labels other than 0 and 1, null ids and documents without a row are left out; a
    document with several labels counts by the smallest, repeated rows once for each.
    With one label alone the score is that label, without any it is 0.5."""
    known = (labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y"))
             .where(F.col("__y").isin(0, 1) & F.col("__id").isNotNull() & ~held_out(F.col("__id")))
             .groupBy("__id").agg(F.min("__y").alias("__y")))
    sample = [known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class) for y in (0, 1)]
    bags = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(
        F.broadcast(sample[0].unionByName(sample[1])), "__id")  # at most 2 * per_class short rows

    def passages(batches):
        for b in batches:
            ids, labels_, rows = [], [], []
            for i, value, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = np.frombuffer((value or "").encode(), np.uint8)
                size = max(1, -(-len(data) // PASSAGE))
                keep = np.arange(size)
                if size > per_doc:
                    keep = np.sort(np.random.default_rng(zlib.crc32(str(i).encode())).permutation(size)[:per_doc])
                kept = [block[keep[(keep >= k * BLOCK) & (keep < (k + 1) * BLOCK)] - k * BLOCK]
                        for k, block in enumerate(passage_blocks(data))]
                counts = np.concatenate(kept)
                ids.append(i)
                labels_.append(y)
                rows.append(counts.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, b.schema.field(0).type), pa.array(labels_, pa.int32()),
                 pa.array(rows, pa.binary())], ["id", "y", "counts"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = bags.select("__id", "__text", "__y").mapInArrow(passages, f"id {kind}, y int, counts binary").toArrow()
    found = sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), got.column(2).to_pylist()))
    if not found:
        return Model({}, 0.5)
    counts = [np.frombuffer(r[2], np.uint16).reshape(-1, WIDTH) for r in found]
    starts = np.append(0, np.cumsum([len(c) for c in counts])[:-1])
    return train(encode(np.concatenate(counts)), starts, np.array([r[1] for r in found], np.float32))


def scorer(model: Model):
    """A column function from text to score; a null text counts as empty."""
    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts))
        bags, at = [], []

        def finish():
            if bags:
                starts = np.append(0, np.cumsum([len(c) for c in bags])[:-1])
                out[at] = model.scores(encode(np.concatenate(bags)), starts)
                bags.clear()
                at.clear()

        for k, v in enumerate(texts):
            data = np.frombuffer(v.as_buffer(), np.uint8) if v.is_valid else np.zeros(0, np.uint8)
            if len(data) > BLOCK * PASSAGE:
                out[k] = model.score_blocks(map(encode, passage_blocks(data)))
                continue
            bags.append(passage_counts(data))
            at.append(k)
            if sum(map(len, bags)) >= BLOCK or len(bags) >= 64:
                finish()
        finish()
        return pa.array(out)

    return score


def score_documents(docs: DataFrame, model: Model, *, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of every whole text in ``out``, null counting as
    empty; rows that repeat get equal scores, an existing column of that name is replaced.
    Long texts are read in passages, all of them.  An empty table gives no rows."""
    return docs.withColumn(out, scorer(model)(F.col(text)))


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", threshold: float = THRESHOLD,
              **kwargs) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``."""
    model = fit(docs, labels, text=text, **kwargs)
    return docs.where(scorer(model)(F.col(text)) >= threshold)
