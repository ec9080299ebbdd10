"""Operator 3: n-gram Jaccard join by chosen paths.

Texts are sets of word n-grams.  Equal sets form one class, so copies cost one row.
Each class carries a signature of minima under random orders of the grams; two sets
agree in a position with a probability equal to their Jaccard similarity.

The join is a forest of splits.  A node draws a few signature positions, and its sets
go to one child for each drawn position and value; sets that stay together for a
while are compared.  A node draws position i when a hash of (path, i) is small, so
every set finds its own way without looking at others, and a level is one shuffle of
(path, class) rows.  Many trees are grown at once, enough for the target recall at
the threshold itself (see ``trees_for``).

At a node,

* a set alone is dropped;
* at the first level every set is compared with one set of the node (a star, linear in
  the node); nodes whose sets are then all in one component are done;
* small nodes are compared in full, between different components only;
* where the sets outside the largest component fit into one block, these are compared
  with all, in blocks, which is linear in the node;
* other nodes are split again; at the last level the sets outside the largest
  component are compared with all, in blocks.

Signatures only propose: within each component that they give, all pairs of classes
are counted exactly, from the sets themselves, in blocks of a bounded number of
grams.  A block gives sums and a spanning tree, never its pairs.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import snapshot
from .common import WORD_BREAKS, fresh
from .components import components
from .streams import Forest, bounds, matrix, runs

N_GRAM = 5
THRESHOLD = 0.8
RECALL = 0.999
POSITIONS = 64         # of a signature
DEPTH = 4              # levels of a tree
SMALL = 64             # sets that are compared in full
BLOCK_GRAMS = 300_000  # grams in one block of the exact count
BLOCK_SETS = 256
BITMAP_WORDS = 1 << 18 # 64-bit words of the bitmap sent to all tasks: 2 MB at any size
SLACK = 0.2            # how far below the threshold a signature still proposes a pair

_TABLE = str.maketrans({c: " " for c in WORD_BREAKS})
#: What str.split() also splits at.
_OTHER_BREAKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_ODD = np.random.default_rng(101).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


# --- sets and signatures ------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A good 64-bit mixing of integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_list(text: str | None) -> list[str]:
    """Words of a text by the breaks of WORD_BREAKS alone; str.split() knows more."""
    if not text:
        return []
    if _OTHER_BREAKS.search(text):
        return [w for w in text.translate(_TABLE).split(" ") if w]
    return text.split()


def grams(text: str | None, n: int) -> np.ndarray:
    """Sorted 64-bit hashes of the n-grams of a text.  A text of fewer than n words is
    one gram, a text without words none."""
    words = word_list(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            total = (total ^ h[k:len(h) - n + 1 + k]) * _ODD[k]
            total ^= total >> np.uint64(29)
        return np.unique(mix(total))


def signature(grams: np.ndarray, positions: int) -> np.ndarray:
    """For each position the least value of the grams under that position's order."""
    odd = mix(np.arange(1, positions + 1, dtype=np.uint64))[:, None] | np.uint64(1)
    low = np.full(positions, 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for k in range(0, len(grams), 8192):
            part = (grams[None, k:k + 8192] * odd).min(axis=1) >> np.uint64(32)
            low = np.minimum(low, part.astype(np.uint32))
    return low.view(np.int32)


def trees_for(recall: float, threshold: float, depth: int, positions: int = POSITIONS) -> int:
    """Trees that find a pair at the threshold with the given probability even if it
    must stay together for ``depth`` levels.  A node draws each position with
    probability 1 / (threshold * positions), so a pair goes to 1 common child on
    average; the chance q(k) to be together after k levels follows from that."""
    draw = 1 / (threshold * positions)
    together = 1.0
    for _ in range(depth):
        together = 1 - (1 - draw * threshold * together) ** positions
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


# --- the join ---------------------------------------------------------------------------

def classes(docs: DataFrame, *, text: str, doc_id: str, n: int, positions: int) -> DataFrame:
    """One row for each row of ``docs``: id, text_hash, set_key (a hash of the whole set,
    null for a text without words), grams (size of the set), sig."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for b in batches:
            keys, sizes, sigs = [], [], []
            for value in b.column(2):
                g = grams(value.as_py(), n)
                sizes.append(len(g))
                digest = hashlib.blake2b(g.tobytes(), digest_size=8).digest() if len(g) else None
                keys.append(digest and int.from_bytes(digest, "little", signed=True))
                sigs.append(signature(g, positions) if len(g) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(sigs, pa.list_(pa.int32()))], ["id", "text_hash", "set_key", "grams", "sig"])

    return docs.select(F.col(doc_id), F.xxhash64(F.col(text)), F.col(text)).mapInArrow(
        run, f"id {kind}, text_hash long, set_key long, grams int, sig array<int>")


def _drawn(path: np.ndarray, positions: int, threshold: float) -> np.ndarray:
    """Which positions the nodes of ``path`` draw, as a matrix of booleans."""
    with np.errstate(over="ignore"):
        h = mix(path[:, None] * np.uint64(0xD6E8FEB86659FD93) + mix(np.arange(1, positions + 1, dtype=np.uint64))[None, :])
    return h < np.uint64(int(2 ** 64 / (threshold * positions)))


def _child(path: np.ndarray, position: np.ndarray, value: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(path * np.uint64(0x9E3779B97F4A7C15) + (position.astype(np.uint64) << np.uint64(32))
                   + value.astype(np.uint32).astype(np.uint64) + np.uint64(1))


def _children(paths: np.ndarray, sigs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child path) for all rows (path, signature)."""
    row, position = np.nonzero(_drawn(paths, sigs.shape[1], threshold))
    return row, _child(paths[row], position, sigs[row, position])


def _roots(sets: DataFrame, trees: int, threshold: float, positions: int) -> DataFrame:
    """First level: the children (path, set_key) of all tree roots."""
    roots = mix(np.arange(1, trees + 1, dtype=np.uint64))
    tree, position = np.nonzero(_drawn(roots, positions, threshold))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            sig = matrix(t, 1, np.int32, positions)
            row = np.repeat(np.arange(len(sig)), len(tree))
            at = np.tile(position, len(sig))
            paths = _child(np.tile(roots[tree], len(sig)), at, sig[row, at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths.view(np.int64)), t.column(0).combine_chunks().take(pa.array(row))], ["path", "set_key"])

    return sets.select("set_key", "sig").mapInArrow(run, "path long, set_key long")


def _star(multi: DataFrame, sets: DataFrame, positions: int, least: int) -> DataFrame:
    """Edges between one set of a node, drawn by a hash, and the node's others."""
    drawn = multi.groupBy("path").agg(F.min_by("set_key", F.xxhash64("path", "set_key")).alias("pivot"))
    pairs = (multi.join(drawn, "path").where("set_key != pivot")
             .select(F.least("pivot", "set_key").alias("a"), F.greatest("pivot", "set_key").alias("b")).distinct())
    pairs = (pairs.join(sets.select(F.col("set_key").alias("a"), F.col("sig").alias("sa")), "a")
             .join(sets.select(F.col("set_key").alias("b"), F.col("sig").alias("sb")), "b"))

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            if t.num_rows:
                close = (matrix(t, 2, np.int32, positions) == matrix(t, 3, np.int32, positions)).sum(1) >= least
                yield from t.select(["a", "b"]).filter(pa.array(close)).to_batches()

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _compare(nodes: DataFrame, positions: int, least: int) -> DataFrame:
    """Edges within nodes (path, part, side, set_key, root, sig) that join different
    components; sides 0 and 1 are compared across, side -1 with itself."""
    def run(batches):
        for t in runs(batches, 2):
            cuts = bounds(t, 2)
            keys, roots = t.column(3).to_numpy(), t.column(4).to_numpy()
            side = t.column(2).to_numpy()
            sig = matrix(t, 5, np.int32, positions)
            out = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                groups = {}
                for r in roots[s:e]:
                    groups.setdefault(r, len(groups))
                if len(groups) < 2:
                    continue
                known = Forest(len(groups))
                label = [groups[r] for r in roots[s:e]]
                for i in range(s, e):
                    close = np.flatnonzero((sig[i + 1:e] == sig[i]).sum(1) >= least) + i + 1
                    for j in close:
                        if (side[i] < 0 or side[i] != side[j]) and known.join(label[i - s], label[j - s]):
                            out.append((keys[i], keys[j]))
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    nodes = nodes.select("path", "part", "side", "set_key", "root", "sig")
    return (nodes.repartition("path", "part").sortWithinPartitions("path", "part", "set_key")
            .mapInArrow(run, "a long, b long"))


def _blocks(rooted: DataFrame, block_sets: int) -> DataFrame:
    """Nodes in blocks: the sets outside a node's largest component (side 0) against
    all its sets (side 1); pairs within that component are not needed."""
    outer, inner = (F.ceil(F.col(c) / block_sets).cast("int") for c in ("n", "minors"))
    rows = rooted.withColumn("outer", outer).withColumn("inner", inner)
    mine = lambda blocks: F.pmod(F.xxhash64("set_key"), F.col(blocks)).cast("int")
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = rows.where("minor").withColumn("i", mine("inner")).withColumn("j", each("outer")).withColumn("side", F.lit(0))
    right = rows.withColumn("j", mine("outer")).withColumn("i", each("inner")).withColumn("side", F.lit(1))
    return left.unionByName(right).withColumn("part", F.col("i") * F.col("outer") + F.col("j"))


def propose(sets: DataFrame, *, threshold: float, recall: float, positions: int, depth: int,
            small: int, slack: float, block_sets: int) -> DataFrame:
    """(v, root): components of the classes by signatures, a superset of the links."""
    least = math.ceil((threshold - slack) * positions)
    level = snapshot(_roots(sets, trees_for(recall, threshold, depth, positions), threshold, positions), "paths")
    edges = known = None
    for at in range(1, depth + 1):
        nodes = level.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        multi = snapshot(level.join(nodes, "path"), "nodes")
        if at == 1:
            edges = snapshot(_star(multi, sets, positions, least), "edges")
            known = components(edges)
        rooted = (multi.join(known, F.col("set_key") == F.col("v"), "left")
                  .withColumn("root", F.coalesce("root", "set_key")).drop("v"))
        shares = rooted.groupBy("path", "root").agg(F.count(F.lit(1)).alias("c"))
        open_ = shares.groupBy("path").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "root")).alias("major"))
        rooted = (rooted.join(open_.where("roots > 1").drop("roots"), "path")
                  .join(sets.select("set_key", "sig"), "set_key")
                  .select("path", "n", "set_key", "root", (F.col("root") != F.col("major.root")).alias("minor"),
                          (F.col("n") - F.col("major.c")).alias("minors"), "sig"))
        rooted = snapshot(rooted, "open-nodes")
        whole, few = F.col("n") <= small, F.col("minors") <= block_sets
        if at < depth:
            full = rooted.where(whole).withColumn("part", F.lit(0)).withColumn("side", F.lit(-1))
            near_done = _blocks(rooted.where(~whole & few), block_sets)
            full = full.unionByName(near_done.select(full.columns))
        else:
            full = _blocks(rooted, block_sets)
        edges = snapshot(edges.union(_compare(full, positions, least)), "edges")
        large = rooted.where(~whole & ~few)
        if at == depth or large.isEmpty():
            break

        def split(batches):
            for b in batches:
                if b.num_rows:
                    t = pa.Table.from_batches([b])
                    row, paths = _children(t.column(0).to_numpy().view(np.uint64), matrix(t, 2, np.int32, positions), threshold)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(paths.view(np.int64)), t.column(1).combine_chunks().take(pa.array(row))], ["path", "set_key"])

        level = snapshot(large.select("path", "set_key", "sig").mapInArrow(split, "path long, set_key long"), "paths")
    return components(edges)


def _shared(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of ``a`` with every set of ``b``."""
    if len(a) * len(b) <= 16:
        return np.array([[len(np.intersect1d(x, y, assume_unique=True)) for y in b] for x in a])
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[code] > 1
    number = np.cumsum(times > 1) - 1
    code, owner = number[code[keep]], owner[keep]
    out = np.zeros((len(a), len(b)))
    order = np.argsort(code, kind="stable")
    code, owner = code[order], owner[order]
    step = 4096
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        s, e = np.searchsorted(code, [low, low + step])
        m = np.zeros((len(a) + len(b), step), np.float32)
        m[owner[s:e], code[s:e] - low] = 1
        out += m[:len(a)] @ m[len(a):].T
    return out


def count_links(members: DataFrame, threshold: float) -> DataFrame:
    """Exact links within proposed components.  ``members`` (comp, part, side, set_key,
    copies, set): blocks to compare, as in _compare.  Rows (a, b, n): an edge when b is
    not null, else n linked documents of class a."""
    def run(batches):
        for t in runs(batches, 2):
            cuts = bounds(t, 2)
            side, keys, copies = (t.column(k).to_numpy() for k in (2, 3, 4))
            col = t.column(5).combine_chunks()
            values, offsets = col.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(col.value_lengths().to_numpy()))
            rows = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                if e - s < 2:
                    continue
                left = np.arange(s, e)[side[s:e] <= 0]
                right = np.arange(s, e)[side[s:e] != 0]
                if not len(left) or not len(right):
                    continue
                sets = lambda at: [values[offsets[k]:offsets[k + 1]] for k in at]
                size = np.diff(offsets)
                both = _shared(sets(left), sets(right))
                link = both >= threshold * (size[left][:, None] + size[right][None, :] - both) - 1e-9
                link &= left[:, None] != right[None, :]
                tree = Forest(e - s)
                for i, j in zip(*np.nonzero(link)):
                    if tree.join(left[i] - s, right[j] - s):
                        rows.append((keys[left[i]], keys[right[j]], 0))
                rows += [(keys[left[i]], None, n) for i, n in enumerate((link * copies[right][None, :]).sum(1)) if n]
                if side[s] >= 0:
                    rows += [(keys[right[j]], None, n) for j, n in enumerate((link * copies[left][:, None]).sum(0)) if n]
            if rows:
                a, b, n = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])

    return (members.select("comp", "part", "side", "set_key", "copies", "set")
            .repartition("comp", "part").sortWithinPartitions("comp", "part", "set_key")
            .mapInArrow(run, "a long, b long, n long"))


def _bitmap(hashes: DataFrame, words: int = BITMAP_WORDS) -> np.ndarray:
    """A bitmap of 64 * ``words`` bits with the bits of these hashes set.  It only thins
    out the rows of a later join, so a full one costs time and changes nothing."""
    word = F.shiftright("text_hash", 6).bitwiseAND(F.lit(words - 1).cast("long"))
    rows = hashes.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(text_hash & 63 as int))")).alias("b")).toArrow()
    out = np.zeros(words, np.uint64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(np.uint64)
    return out


def _marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit in a bitmap."""
    return (bits[(hashes >> 6) & (len(bits) - 1)] >> (hashes & 63).astype(np.uint64)) & np.uint64(1) > 0


def similarity_join(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", n: int = N_GRAM,
                    threshold: float = THRESHOLD, recall: float = RECALL, positions: int = POSITIONS,
                    depth: int = DEPTH, small: int = SMALL, slack: float = SLACK,
                    block_grams: int = BLOCK_GRAMS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, text_hash, n_links, class_id, kept.

    n_links counts the other rows whose n-gram sets have a Jaccard similarity of at
    least ``threshold``, copies included; class_id is the smallest doc_id in the
    connected component (null ids come last), and kept marks the row of each component
    with the smallest (doc_id, text_hash).  Repeated rows are copies of each other and
    all marked alike.  Null and empty texts have no n-grams: no links, each its own
    class, kept.  A text of fewer than n words is one n-gram.  Other columns are not
    read.  An empty table gives no rows."""
    rows = snapshot(classes(docs, text=text, doc_id=doc_id, n=n, positions=positions), "rows")
    leader = F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash")
    sets = snapshot(rows.where("set_key is not null").groupBy("set_key").agg(
        F.count(F.lit(1)).alias("copies"), F.min(leader).alias("leader"),
        F.first("grams").alias("grams"), F.first("sig").alias("sig")), "sets")
    known = propose(sets, threshold=threshold, recall=recall, positions=positions, depth=depth,
                    small=small, slack=slack, block_sets=block_sets)
    members = snapshot(sets.drop("sig").join(known, F.col("set_key") == F.col("v")).drop("v"), "members")
    total = members.groupBy("root").agg(F.greatest(
        F.ceil(F.count(F.lit(1)) / block_sets), F.ceil(F.sum("grams") / block_grams)).cast("int").alias("blocks"))
    members = members.join(total.withColumnRenamed("root", "comp"), F.col("root") == F.col("comp")).drop("root")

    wanted = _bitmap(members.select("leader.text_hash"))

    def to_sets(batches):
        for b in batches:
            b = b.filter(pa.array(_marked(wanted, b.column(1).to_numpy())))
            found = [grams(v.as_py(), n).view(np.int64) for v in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.int64()))], ["id", "hash", "set"])

    kind = docs.schema[doc_id].dataType.simpleString()
    found = docs.select(F.col(doc_id), F.xxhash64(F.col(text)), F.col(text)).mapInArrow(
        to_sets, f"id {kind}, hash long, set array<long>")
    found = members.join(found, F.col("leader.id").eqNullSafe(F.col("id")) & (F.col("leader.text_hash") == F.col("hash")))
    sized = snapshot(found.select("comp", "blocks", "set_key", "copies", "set").dropDuplicates(["set_key"]), "gram-sets")
    mine = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int")
    parts = (sized.withColumn("mine", mine)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .withColumn("part", F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other"))
             .withColumn("side", F.when(F.col("mine") == F.col("other"), -1)
                         .otherwise((F.col("mine") > F.col("other")).cast("int"))))
    links = snapshot(count_links(parts, threshold), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("linked"))
    joined = components(links.where("b is not null").select("a", "b")).withColumnRenamed("v", "w")
    per_set = (sets.join(counts, F.col("set_key") == F.col("v"), "left")
               .join(joined, F.col("set_key") == F.col("w"), "left")
               .select("set_key", "leader", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("root", "set_key").alias("root")))
    best = per_set.groupBy("root").agg(F.min("leader").alias("best"))
    per_set = snapshot(per_set.drop("leader").join(best, "root").select("set_key", "n_links", "best"), "classes")
    out = rows.join(per_set.withColumnRenamed("set_key", "s"), F.col("set_key") == F.col("s"), "left")
    alone = F.col("set_key").isNull()
    return out.select(
        F.col("id").alias("doc_id"), "text_hash", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("class_id"),
        (alone | (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_hash") == F.col("best.text_hash")))).alias("kept"))


def one_of_each(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **kwargs) -> DataFrame:
    """``docs`` with one row of each component; of rows with equal id and text one stays.

    Rows whose (id, text) is kept and unique need no decision.  A bitmap of fixed size
    tells most of them, so only the others' texts are shuffled to meet it."""
    found = snapshot(similarity_join(docs, text=text, doc_id=doc_id, **kwargs), "links-of-rows")
    doubt = snapshot(found.groupBy("doc_id", "text_hash").agg(F.min("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
                     .where("not kept or n > 1"), "doubtful")
    bits = _bitmap(doubt.select("text_hash"))

    @F.arrow_udf("boolean")
    def doubtful(hashes: pa.Array) -> pa.Array:
        return pa.array(_marked(bits, hashes.to_numpy(zero_copy_only=False)))

    key, gone_id, gone = fresh(docs, "__hash"), fresh(docs, "__id"), fresh(docs, "__h")
    keyed = docs.withColumn(key, F.xxhash64(F.col(text)))
    sure = keyed.where(~doubtful(F.col(key)))
    drop = doubt.where("not kept").select(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone))
    rest = keyed.where(doubtful(F.col(key)))
    rest = rest.join(drop, rest[doc_id].eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone)), "left_anti")
    return sure.unionByName(rest.dropDuplicates([doc_id, key])).drop(key)
