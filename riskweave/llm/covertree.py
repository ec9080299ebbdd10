"""Operator 8: near duplicates of vectors by dual traversal of cover trees.

Vectors of one label are ordered by their first coordinate and cut into blocks.
Each block becomes a cover tree: nested levels, the radius halving from level to
level, every node standing for the points below it, with the distance of the farthest
of them (its cover).  Two trees are walked together: a pair of nodes whose distance
exceeds both covers and the distance of the threshold is dropped, others are opened.
What is left at the last level is compared exactly, so the pairs are exact.

On unit vectors a cosine of c is a distance of sqrt(2 - 2c).  Pairs of blocks that
lie too far apart along the ordering never meet.  A pair of blocks gives sums and a
spanning forest, never its pairs; equal vectors are one point with a count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import snapshot
from .components import components
from .streams import Forest, bounds, runs
from .vectors import usable

THRESHOLD = 0.98
BLOCK = 4096
TILE = 512             # rows of a distance matrix at a time


class CoverTree:
    """Levels of nodes over unit vectors.  ``levels[k]`` holds node centres (point
    numbers, each level contains the one before), ``children[k][c]`` the centres of the
    next level below c, ``cover[k][c]`` the distance to the farthest point below c."""

    def __init__(self, x: np.ndarray, lowest: float, radius: float = 2.0):
        self.x = x
        self.children: list[dict[int, np.ndarray]] = []
        self.cover: list[np.ndarray] = []
        groups = {0: np.arange(len(x))}
        self.cover.append(self._covers(groups))
        while radius > lowest:
            radius /= 2
            below: dict[int, np.ndarray] = {}
            nodes: dict[int, np.ndarray] = {}
            for centre, points in groups.items():
                mine, own = [], x[points]
                free, c = np.ones(len(points), bool), centre  # a centre leads its first child
                while c >= 0:
                    near = free & (own @ x[c] >= 1 - radius * radius / 2)
                    near |= points == c
                    nodes[c] = points[near]
                    mine.append(c)
                    free &= ~near
                    at = int(free.argmax())
                    c = int(points[at]) if free[at] else -1
                below[centre] = np.array(mine)
            self.children.append(below)
            groups = nodes
            self.cover.append(self._covers(groups))
        self.leaves = groups

    def _covers(self, groups: dict[int, np.ndarray]) -> np.ndarray:
        out = np.zeros(len(self.x))
        for c, points in groups.items():
            if len(points) > 1:
                out[c] = _distance(self.x[points], self.x[c:c + 1]).max()
        return out


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)))


def close_leaves(left: CoverTree, right: CoverTree, reach: float):
    """Pairs of leaf centres whose points may be within ``reach``, by walking both
    trees; for a tree with itself each pair of nodes once."""
    if not len(left.x) or not len(right.x):
        return []
    same = left is right
    pairs = [(0, 0)]
    for level in range(len(left.children)):
        lower, upper = left.cover[level + 1], right.cover[level + 1]
        opened = []
        for a, b in pairs:
            ca, cb = left.children[level][a], right.children[level][b]
            for s in range(0, len(ca), TILE):
                part = ca[s:s + TILE]
                near = _distance(left.x[part], right.x[cb]) <= lower[part][:, None] + upper[cb][None, :] + reach + 1e-7
                i, j = np.nonzero(near)
                u, v = part[i], cb[j]
                if same and a == b:
                    keep = u <= v
                    u, v = u[keep], v[keep]
                opened += zip(u.tolist(), v.tolist())
        pairs = opened
    return pairs


def block_links(x: np.ndarray, y: np.ndarray | None, threshold: float):
    """Pairs (rows of x, rows of y) with cosine >= threshold, in parts; without y the
    pairs of x with itself, each once."""
    norm = lambda v: np.sqrt((v * v).sum(1))
    nx, ny = norm(x), norm(x if y is None else y)
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    left = CoverTree(x / nx[:, None], reach / 2)
    right = left if y is None else CoverTree(y / ny[:, None], reach / 2)
    z = x if y is None else y
    for a, b in close_leaves(left, right, reach):
        p, q = left.leaves[a], right.leaves[b]
        for s in range(0, len(p), TILE):
            part = p[s:s + TILE]
            i, j = np.nonzero((x[part] @ z[q].T) / (nx[part][:, None] * ny[q][None, :]) >= threshold)
            i, j = part[i], q[j]
            if y is None and a == b:
                keep = i < j
                i, j = i[keep], j[keep]
            if len(i):
                yield i, j


def _links(pairs: DataFrame, threshold: float) -> DataFrame:
    """Rows (pair, side, point, copies, x) to (a, b, n): an edge, or without b the number
    of linked vectors of point a.  side -1: one block with itself."""
    def run(batches):
        for t in runs(batches, 1):
            cuts = bounds(t, 1)
            side, point, copies = (t.column(c).to_numpy() for c in (1, 2, 3))
            lists = t.column(4).combine_chunks()
            for s, e in zip(cuts[:-1], cuts[1:]):
                x = lists.slice(s, e - s).flatten().to_numpy().reshape(e - s, -1)
                left = np.flatnonzero(side[s:e] <= 0)
                right = left if side[s] < 0 else np.flatnonzero(side[s:e] == 1)
                mine, weight = point[s:e], copies[s:e]
                linked, tree, rows = np.zeros(e - s, np.int64), Forest(e - s), []
                for i, j in block_links(x[left], None if side[s] < 0 else x[right], threshold):
                    i, j = left[i], right[j]
                    np.add.at(linked, i, weight[j])
                    np.add.at(linked, j, weight[i])
                    rows += [(mine[u], mine[v], 0) for u, v in zip(i.tolist(), j.tolist()) if tree.join(u, v)]
                rows += [(mine[u], None, linked[u]) for u in np.flatnonzero(linked)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b", "n"])

    return (pairs.select("pair", "side", "point", "copies", "x").repartition("pair")
            .sortWithinPartitions("pair", "side", "point").mapInArrow(run, "a long, b long, n long"))


def near_duplicates(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``vectors``: vec_id, n_links, component_id, kept.

    Rows of equal labels are linked if their cosine in double precision is at least
    ``threshold``.  Rows with a null label and vectors that are null, empty, zero or
    hold null or non-finite components link with nothing.  component_id is the smallest
    id reachable (null ids come last), kept says whether the row has it.  Rows that
    repeat are linked with each other.  Vectors of other dimensions never link.  Other
    columns are not read, an empty table gives no rows."""
    x = F.col(vector).cast("array<double>")
    ok = usable(F.col(vector)) & F.col(label).isNotNull() & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(vec_id).alias("id"), F.when(ok, F.col(label)).alias("label"), F.when(ok, x).alias("x"))
    rows = snapshot(rows.withColumn("point", F.when(F.col("x").isNotNull(), F.xxhash64("label", "x"))), "rows")
    points = (rows.where("point is not null").groupBy("point", "label", "x")
              .agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least")))
    # The order is that of the first coordinate of the unit vectors: a difference there is
    # at most their distance.
    length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    points = snapshot(points.withColumn("dim", F.size("x")).withColumn("place", F.element_at("x", 1) / length), "points")
    n = points.count()
    parts = max(1, -(-n // block))
    ranged = (points.repartitionByRange(parts, "label", "dim", "place", "point")
              .select("*", F.spark_partition_id().alias("part")))
    within = F.row_number().over(Window.partitionBy("part", "label", "dim").orderBy("place", "point")) - 1
    placed = ranged.withColumn("piece", F.floor(within / block))
    placed = snapshot(placed.withColumn("block", F.xxhash64("part", "label", "dim", "piece")).drop("part", "piece"), "blocks")
    shape = snapshot(placed.groupBy("label", "dim", "block").agg(F.min("place").alias("low"), F.max("place").alias("high")), "shape")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-7
    other = shape.select(F.col("label").alias("l"), F.col("dim").alias("d"), F.col("block").alias("other"),
                         F.col("low").alias("low2"), F.col("high").alias("high2"))
    meets = shape.join(other, (F.col("label") == F.col("l")) & (F.col("dim") == F.col("d")) & (F.col("block") <= F.col("other"))
                       & (F.col("low") <= F.col("high2") + reach) & (F.col("low2") <= F.col("high") + reach))
    meets = meets.select("block", "other", F.xxhash64("block", "other").alias("pair"))
    sides = meets.select(F.col("pair"), F.inline(F.when(
        F.col("block") == F.col("other"), F.array(F.struct(F.col("block").alias("which"), F.lit(-1).alias("side")))).otherwise(
        F.array(F.struct(F.col("block").alias("which"), F.lit(0).alias("side")),
                F.struct(F.col("other").alias("which"), F.lit(1).alias("side"))))))
    links = snapshot(_links(placed.join(sides, F.col("block") == F.col("which")), threshold), "links")
    counts = links.where("b is null").groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("linked"))
    joined = components(links.where("b is not null").select("a", "b")).withColumnRenamed("v", "w")
    per_point = (points.join(counts, F.col("point") == F.col("v"), "left")
                 .join(joined, F.col("point") == F.col("w"), "left")
                 .select("point", "least", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("root", "point").alias("root")))
    best = per_point.groupBy("root").agg(F.min("least").alias("best"))
    per_point = (per_point.join(best, "root").select(F.col("point").alias("p"), "n_links", "best"))
    out = rows.select("id", "point").join(per_point, F.col("point") == F.col("p"), "left")
    component = F.when(F.col("point").isNull(), F.col("id")).otherwise(F.col("best"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
