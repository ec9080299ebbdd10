"""Operator 12: benchmark decontamination.

Windows of consecutive normalised words are taken from every benchmark item and sent to
all tasks as a set of 64-bit hashes.  Tasks scan the word stream of each whole text,
look the hash of every window up, and compare the words of what is found, so a hit is
never a hash alone.  Words inside a hit are marked; spans of them, or whole documents,
can be removed.

The set is cut into blocks of a bounded number of bytes.  One block is the usual case;
each further one costs another scan, and the marks of all are united.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import snapshot
from .wordstream import Part, kinds_of, mix, parts

KINDS = kinds_of(word=bytes([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]))
WINDOW = 10
BLOCK_BYTES = 32 << 20   # of windows in one broadcast block
FILTER_BITS = 22         # bits that are looked at before the sorted hashes

_ODD = mix(np.arange(1001, 1129, dtype=np.uint64)) | np.uint64(1)


def _window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on."""
    size = max(0, len(hashes) - n + 1)
    total = np.full(size, n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            total += hashes[k:k + size] * _ODD[k % len(_ODD)] + np.uint64(k // len(_ODD))
    return mix(total)


def windows(benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(words, h, phrase, item): the different windows of each item, as many words, their
    hash, and the words joined by blanks.  An item of fewer words than a window is one
    window; null and empty texts have none."""
    kind = benchmark.schema[item_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            items = b.column(0)
            for part in parts(b.column(1), KINDS, window - 1):
                sizes = np.bincount(part.row - part.rows.start, minlength=len(part.rows))
                short = sizes < window if part.first else np.zeros(len(sizes), bool)
                begins = np.append(0, np.cumsum(sizes)[:-1])
                for n in sorted({window, *sizes[short & (sizes > 0)].tolist()}):
                    if n == window:
                        at = np.arange(max(0, len(part.starts) - n + 1))
                        at = at[(at < part.own) & (part.row[at] == part.row[at + n - 1])]
                    else:
                        at = begins[short & (sizes == n)]
                    if len(at):
                        spelled = [part.words.take(pa.array(part.codes[at + k])) for k in range(n)]
                        phrase = pc.binary_join_element_wise(*spelled, " ") if n > 1 else spelled[0]
                        h = _window_hashes(part.hashes, n)[at].view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), n, np.int32)), pa.array(h), phrase,
                             items.take(pa.array(part.row[at]))], ["words", "h", "phrase", "item"])

    return (benchmark.select(F.col(item_id), F.col(text).cast("string"))
            .mapInArrow(run, f"words int, h long, phrase string, item {kind}").distinct())


class Block:
    """Some windows, ready to be looked up."""

    def __init__(self, found: pa.Table):
        self.items = found.column("item").combine_chunks().unique().drop_null()
        number = {v: k for k, v in enumerate(self.items.to_pylist())}
        by_size: dict[int, dict] = {}
        for n, h, phrase, item in zip(*(found.column(c).to_pylist() for c in ("words", "h", "phrase", "item"))):
            held = by_size.setdefault(n, {}).setdefault((h & 0xFFFFFFFFFFFFFFFF, phrase), [])
            if item is not None:
                held.append(number[item])
        self.sizes = []
        for n, held in sorted(by_size.items()):
            keys = sorted(held)
            h = np.array([k[0] for k in keys], np.uint64)
            near = np.zeros(1 << FILTER_BITS, bool)
            near[(h & np.uint64(len(near) - 1)).astype(np.int64)] = True
            words = [pa.array(column) for column in zip(*(k[1].split(" ") for k in keys))]
            lists = [sorted(held[k]) for k in keys]
            self.sizes.append((n, h, np.packbits(near), words, np.append(0, np.cumsum([len(x) for x in lists])),
                               np.array([i for x in lists for i in x], np.int64)))

    def find(self, part: Part) -> tuple[np.ndarray, np.ndarray]:
        """(marks, pairs): which words of the part are hit by windows that begin among its
        own, and the different (row, item number) of these windows."""
        marks = np.zeros(len(part.starts) + 1, np.int64)
        pairs = [np.zeros((0, 2), np.int64)]
        for n, h, near, words, cuts, items in self.sizes:
            mine = _window_hashes(part.hashes, n)
            low = (mine & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
            at = np.flatnonzero((near[low >> 3] >> (7 - (low & 7)).astype(np.uint8)) & np.uint8(1))
            at = at[(at < part.own) & (part.row[at] == part.row[at + n - 1])]
            first, end = np.searchsorted(h, mine[at]), np.searchsorted(h, mine[at], side="right")
            at, which = np.repeat(at, end - first), _ranges(first, end)
            same = np.ones(len(at), bool)
            for k in range(n):
                if len(at):
                    ours = part.words.take(pa.array(part.codes[at + k]))
                    same &= pc.equal(ours, words[k].take(pa.array(which))).to_numpy(zero_copy_only=False)
            at, which = at[same], which[same]
            if len(at):
                np.add.at(marks, at, 1)
                np.add.at(marks, at + n, -1)
                seen = np.unique(np.stack([part.row[at], which], 1), axis=0)
                lengths = cuts[seen[:, 1] + 1] - cuts[seen[:, 1]]
                numbers = items[_ranges(cuts[seen[:, 1]], cuts[seen[:, 1] + 1])]
                pairs.append(np.stack([np.repeat(seen[:, 0], lengths), numbers], 1))
        return np.cumsum(marks)[:-1] > 0, np.concatenate(pairs)


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """first[0], ..., end[0] - 1, first[1], ... as one array."""
    lengths = end - first
    return np.arange(lengths.sum()) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)


def _scan(texts: pa.Array, block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each row, hit words as rows (row, place, first character, end), pairs)."""
    total = np.zeros(len(texts), np.int64)
    hits, pairs = [np.zeros((0, 4), np.int64)], [np.zeros((0, 2), np.int64)]
    carried = np.zeros(0, bool)     # marks of words that were shown ahead
    chars_before = bytes_before = 0
    previous = None
    for part in parts(texts, KINDS, window - 1):
        marks, found = block.find(part)
        pairs.append(found)
        if part.first:
            carried, chars_before, bytes_before = carried[:0], 0, 0
        else:
            chars_before += int(_characters(previous.data[:part.base - bytes_before]).sum())
            bytes_before = part.base
            marks[:len(carried)] |= carried[:len(marks)]
        at = np.flatnonzero(marks[:part.own])
        if len(at):
            chars = np.append(0, np.cumsum(_characters(part.data)))
            begins = np.searchsorted(part.row, part.row[at])      # first word of the row in this part
            row_byte = part.cuts[part.row[at] - part.rows.start]
            place = at - begins + (0 if part.first else total[part.rows.start])
            hits.append(np.stack([part.row[at], place, chars[part.starts[at]] - chars[row_byte] + chars_before,
                                  chars[part.ends[at]] - chars[row_byte] + chars_before], 1))
        carried = marks[part.own:].copy()
        np.add.at(total, part.row[:part.own], 1)
        previous = part
    return total, np.concatenate(hits), np.unique(np.concatenate(pairs), axis=0)


def _characters(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _lists(rows: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """Lists of values by row, of n rows; ``rows`` ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)).astype(np.int32)), values)


def _united(a: list, b: list) -> list:
    """Runs of words that either list holds."""
    out: list = []
    for run in sorted([*(a or []), *(b or [])], key=lambda r: (r["first"], r["last"])):
        if out and run["first"] <= out[-1]["last"]:
            if run["last"] > out[-1]["last"]:
                out[-1] = out[-1] | {"last": run["last"], "end": run["end"]}
        else:
            out.append(dict(run))
    return out


def find_hits(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", bench_text: str = "text",
              item_id: str = "item_id", window: int = WINDOW, out: str = "hits",
              block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct ``out``: n_words, items (the different ids of items with a
    window in the text), runs (stretches of hit words: first and last word, exclusive,
    from 0, and start and end character).

    Null and empty texts have no words, and no item has their window; an empty benchmark
    or table hits nothing.  Items that share an id are one item; windows of items without
    id mark words but name no item.  Repeated rows are marked alike.  Long texts are
    scanned in stretches that overlap by a window.  An existing column ``out`` is
    replaced, other columns pass through."""
    spark = docs.sparkSession
    kind = benchmark.schema[item_id].dataType
    every = snapshot(windows(benchmark, text=bench_text, item_id=item_id, window=window), "bench-windows")
    held = every.agg(F.sum(F.octet_length("phrase") + F.lit(64))).first()[0] or 0
    blocks = held // block_bytes + 1
    every = every.withColumn("block", F.pmod(F.xxhash64("phrase", "item"), F.lit(blocks)))
    run_type = "array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"
    schema = f"struct<n_words:bigint,items:array<{kind.simpleString()}>,runs:{run_type}>"

    def finder(block):
        def scan(texts: pa.Array) -> pa.Array:
            ready = block.value
            total, hits, pairs = _scan(texts, ready, window)
            fresh = np.ones(len(hits), bool)
            fresh[1:] = (hits[1:, 0] != hits[:-1, 0]) | (hits[1:, 1] != hits[:-1, 1] + 1)
            head = np.flatnonzero(fresh)
            tail = np.append(head[1:], len(hits))[:len(head)] - 1
            runs = pa.StructArray.from_arrays(
                [pa.array(hits[head, 1]), pa.array(hits[tail, 1] + 1), pa.array(hits[head, 2]), pa.array(hits[tail, 3])],
                ["first", "last", "start", "end"])
            return pa.StructArray.from_arrays(
                [pa.array(total), _lists(pairs[:, 0], len(texts), ready.items.take(pa.array(pairs[:, 1]))),
                 _lists(hits[head, 0], len(texts), runs)], ["n_words", "items", "runs"])

        @F.arrow_udf(schema)
        def find(texts: pa.Array) -> pa.Array:
            return scan(texts)

        @F.arrow_udf(schema)
        def find_more(texts: pa.Array, before: pa.Array) -> pa.Array:
            found = scan(texts).to_pylist()
            for new, old in zip(found, before.to_pylist()):
                new["items"] = list(dict.fromkeys([*old["items"], *new["items"]]))
                new["runs"] = _united(old["runs"], new["runs"])
            return pa.array(found, before.type)

        return find, find_more

    for k in range(blocks):
        block = spark.sparkContext.broadcast(Block(every.where(F.col("block") == k).drop("block").toArrow()))
        find, find_more = finder(block)
        value = F.col(text).cast("string")
        if k == 0:
            docs = docs.withColumn(out, find(value))
        else:
            docs = snapshot(docs, "bench-hits").withColumn(out, find_more(value, F.col(out)))
    return docs


def n_hit(hits: str = "hits"):
    """Number of hit words of a struct that find_hits gives."""
    return F.aggregate(F.col(f"{hits}.runs"), F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "spans", text: str = "text", **kwargs) -> DataFrame:
    """``docs`` without what the benchmark holds: ``remove`` spans of hit words from the
    texts, or whole ``documents`` with a hit.  A null text stays null."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    out = "hits"
    while out in docs.columns:
        out += "_"
    found = find_hits(docs, benchmark, text=text, out=out, **kwargs)
    if remove == "documents":
        return found.where(F.size(f"{out}.runs") == 0).drop(out)
    runs = F.col(f"{out}.runs")
    kept = F.transform(F.sequence(F.lit(0), F.size(runs)), lambda k: F.substring(
        F.col(text), F.when(k == 0, F.lit(0)).otherwise(F.get(runs, k - 1)["end"]).cast("int") + 1,
        (F.coalesce(F.get(runs, k)["start"], F.length(text).cast("long"))
         - F.when(k == 0, F.lit(0)).otherwise(F.get(runs, k - 1)["end"])).cast("int")))
    clean = F.when(F.size(runs) > 0, F.array_join(kept, "")).otherwise(F.col(text))
    return found.withColumn(text, clean).drop(out)
