"""Operator 6: exact top-k inner products by norm-bucketed retrieval.

Candidates are ordered by length and cut into buckets of similar length, longest
first.  A query that already has k scores can ask of a bucket only for products of at
least its k-th score t, that is for a cosine of at least t / (|query| * longest in
the bucket).  If that local threshold is over 1 the bucket is skipped; if it is high,
candidates must lie in narrow ranges of the query's largest coordinates; if it is low,
they must be long enough.  What is left is verified by integer products.

Queries come in blocks.  Each block meets the longest bucket first, which gives every
query a lower bound of its k-th score; block and bucket pairs that the bounds rule
out are never formed.  The other buckets of a block are dealt out in teams; a team is
searched longest bucket first, each bucket raising the bounds for the next, and returns
k rows a query once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import snapshot
from .streams import bounds, runs
from .vectors import usable

K = 20
SCALE = 64
BUCKET = 4096          # candidates of one bucket
BLOCK = 2048           # queries of one block
FOCUS = 4              # coordinates of a query that prune
HIGH = 0.55            # local cosine threshold from which coordinates prune
TEAM = 4               # buckets that one group of rows goes through
EXACT = 2.0 ** 52      # products of lengths up to here are exact in doubles
LARGEST = 2 ** 63 - 1


def integers(vectors: DataFrame, *, vec_id: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, dim, x array<long>, norm2 double, copies) of the vectors that take part;
    rows equal in id and x are one with a count."""
    x = F.transform(F.col(vector).cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale))))
    found = vectors.where(usable(F.col(vector))).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x"))
    found = found.groupBy("vec_id", "x").agg(F.count(F.lit(1)).alias("copies"))
    norm2 = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return found.select("vec_id", F.size("x").alias("dim"), "x", norm2.alias("norm2"), "copies")


def products(x: np.ndarray, q: np.ndarray, longest: float) -> np.ndarray:
    """Inner products of whole numbers as int64; ``longest`` bounds the product of the
    lengths.  What doubles can't hold exactly is computed in Python's integers; what 64
    bits can't hold becomes the nearest number that they can."""
    if longest <= EXACT:
        return (x.astype(float) @ q.astype(float)).astype(np.int64)
    exact = x.astype(object) @ q.astype(object)
    return np.array([max(-LARGEST, min(LARGEST, v)) for v in exact], np.int64)


def best(ids: np.ndarray, missing: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, rows without an id last."""
    at = np.arange(len(scores))
    if len(at) > k:
        at = at[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
    return at[np.lexsort((ids[at], missing[at], -scores[at]))[:k]]


def best_of(queries: np.ndarray, qnorm: np.ndarray, qrow: np.ndarray, floor: np.ndarray, x: np.ndarray, norm: np.ndarray,
            row: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int, focus: int, high: float):
    """For each query the candidates of one bucket (longest first) that may be among
    its k best: (row of the query, rows of the candidates, scores).  ``floor`` holds the
    lower bounds of the k-th scores and is raised.  A candidate whose ``row`` is the
    query's is its own row."""
    unit = x / np.maximum(norm, 1e-300)[:, None]
    low, large = unit.min(axis=0), unit.max(axis=0)
    for i, q in enumerate(queries):
        t, n = floor[i], qnorm[i]
        at = None
        if np.isfinite(t) and t > 0 and n > 0:
            local = t / (n * norm[0]) if norm[0] else np.inf
            if local > 1 + 1e-9:
                continue
            end = int(np.searchsorted(-norm, -(t / n) * (1 - 1e-12), side="right"))  # long enough
            if local >= high:
                u = q / n
                slack = np.sqrt(max(0.0, 1 - local * local))
                at = np.arange(end)
                for f in np.argsort(-np.abs(u))[:focus]:
                    # Along u a unit vector has between local and 1, across it at most the slack.
                    half = slack * np.sqrt(max(0.0, 1 - u[f] * u[f])) + 1e-9
                    lo, hi = min(u[f], u[f] * local) - half, max(u[f], u[f] * local) + half
                    if lo > low[f] or hi < large[f]:
                        at = at[(unit[at, f] >= lo) & (unit[at, f] <= hi)]
            else:
                at = np.arange(end)
        else:
            at = np.arange(len(x))
        scores = products(x[at], q, n * norm[0])
        keep = row[at] != qrow[i]
        if np.isfinite(t):
            keep &= scores >= t - abs(t) * 1e-15
        at, scores = at[keep], scores[keep]
        top = best(ids[at], missing[at], scores, k)
        at, scores = at[top], scores[top]
        if len(at) == k:
            floor[i] = max(floor[i], scores.min())
        if len(at):
            yield i, at, scores


def _search(pairs: DataFrame, k: int, bucket: int, focus: int, high: float) -> DataFrame:
    """Rows (block, team, side, row, vec_id, norm2, floor, x), queries (side 0) and
    candidates (side 1) of each block and team, to (query_row, query_id, vec_id, score)."""
    def run(batches):
        for t in runs(batches, 2):
            cuts = bounds(t, 2)
            side, row, norm2 = (t.column(c).to_numpy() for c in (2, 3, 5))
            missing = t.column(4).combine_chunks().is_null().to_numpy(zero_copy_only=False)
            ids = t.column(4).combine_chunks().fill_null(0).to_numpy()
            floors = t.column(6).to_numpy().astype(float)
            lists = t.column(7).combine_chunks()
            for s, e in zip(cuts[:-1], cuts[1:]):
                x = lists.slice(s, e - s).flatten().to_numpy().reshape(e - s, -1)
                is_query = side[s:e] == 0
                q, c = np.flatnonzero(is_query), np.flatnonzero(~is_query)
                if not len(q) or not len(c):
                    continue
                c = c[np.lexsort((row[s:e][c], -norm2[s:e][c]))]
                norm = np.sqrt(norm2[s:e])
                floor, found = floors[s:e][q].copy(), [[] for _ in q]
                for part in (c[p:p + bucket] for p in range(0, len(c), bucket)):
                    for i, at, scores in best_of(x[q], norm[q], row[s:e][q], floor, x[part], norm[part], row[s:e][part],
                                                 ids[s:e][part], missing[s:e][part], k, focus, high):
                        found[i].append((s + part[at], scores))
                out = []
                for i, parts in enumerate(found):
                    if parts:
                        at, scores = (np.concatenate(v) for v in zip(*parts))
                        top = best(ids[at], missing[at], scores, k)
                        out.append((np.full(len(top), s + q[i]), at[top], scores[top]))
                if out:
                    asked, at, scores = (np.concatenate(v) for v in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row[asked]), pa.array(ids[asked]), pa.array(ids[at], mask=missing[at]), pa.array(scores)],
                        ["query_row", "query_id", "vec_id", "score"])

    return (pairs.select("block", "team", "side", "row", "vec_id", "norm2", "floor", "x")
            .repartition("block", "team").sortWithinPartitions("block", "team", "side")
            .mapInArrow(run, "query_row long, query_id long, vec_id long, score long"))


def top_products(vectors: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", every: int = 20,
                 k: int = K, scale: int = SCALE, bucket: int = BUCKET, block: int = BLOCK,
                 focus: int = FOCUS, high: float = HIGH, team: int = TEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``
    the k rows of highest inner product of floor(scale * x), its own row excluded, ties
    to the smaller id; all rows if there are fewer.

    Rows with a null or empty vector or null or non-finite components take no part.  Rows
    that repeat an id are rows like any other: each is a candidate of the others and, if
    its id asks, a query.  Rows with a null id are candidates, last of equal scores.
    Vectors meet those of their own dimension only.  A score that 64 bits can't hold
    counts as the nearest that they can.  Other columns are not read, an empty table
    gives no rows."""
    rows = integers(vectors, vec_id=vec_id, vector=vector, scale=scale)
    rows = snapshot(rows.withColumn("row", F.monotonically_increasing_id()), "integers")
    n = rows.count()
    queries = rows.where(F.col("vec_id") % every == 0)
    # No result holds more than k of equal rows.  A query's own row is the one copy that
    # keeps its number; further copies are candidates of it, too.
    copies = F.least(F.col("copies"), F.lit(k + 1)).cast("int")
    rows = (rows.withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
            .withColumn("row", F.when(F.col("copy") == 0, F.col("row")).otherwise(F.lit(-1))).drop("copy"))
    # Buckets: ranges of (dimension, length); a range partition is cut into buckets.
    parts = max(1, -(-n // bucket))
    ranged = (rows.repartitionByRange(parts, F.col("dim"), F.desc("norm2"), F.col("vec_id"), F.col("row"))
              .select("*", F.spark_partition_id().alias("part")))
    within = F.row_number().over(Window.partitionBy("part", "dim").orderBy(F.desc("norm2"), "vec_id", "row")) - 1
    placed = ranged.withColumn("piece", F.floor(within / bucket))
    placed = snapshot(placed.withColumn("bucket", F.xxhash64("part", "dim", "piece")).drop("part", "piece"), "buckets")
    shape = placed.groupBy("bucket", "dim").agg(F.max("norm2").alias("longest"), F.count(F.lit(1)).alias("n"))
    first = (shape.where(F.col("n") > k).groupBy("dim")
             .agg(F.max_by("bucket", F.struct("longest", "bucket")).alias("first")))
    blocks = max(1, -(-n // (every * block)))
    queries = snapshot(queries.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("long")), "queries")
    none = F.lit(None).cast("double")

    def paired(asked: DataFrame, meets: DataFrame) -> DataFrame:
        """Rows of blocks and teams that meet; ``meets`` (b, d, bucket, t), a row for each bucket."""
        teams = meets.select("b", "d", "t").distinct()
        q = asked.join(teams, (F.col("block") == F.col("b")) & (F.col("dim") == F.col("d"))).select(
            "block", F.col("t").alias("team"), F.lit(0).alias("side"), "row", "vec_id", "norm2", "floor", "x")
        c = placed.join(meets.select(F.col("b").alias("block"), F.col("bucket").alias("u"), F.col("t").alias("team")),
                        F.col("bucket") == F.col("u")).select(
            "block", "team", F.lit(1).alias("side"), "row", "vec_id", "norm2", none.alias("floor"), "x")
        return q.union(c)

    heads = queries.select(F.col("block").alias("b"), F.col("dim").alias("d")).distinct()
    start = (heads.join(first.withColumnRenamed("dim", "d1"), F.col("d") == F.col("d1"))
             .select("b", "d", F.col("first").alias("bucket"), F.col("first").alias("t")))
    found = snapshot(_search(paired(queries.withColumn("floor", F.lit(float("-inf"))), start), k, bucket, focus, high), "found")
    floor = (found.groupBy(F.col("query_row").alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor"))
             .where(F.col("n") >= k).select("r", "floor"))
    asked = snapshot(queries.join(floor, F.col("row") == F.col("r"), "left")
                     .withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).drop("r"), "asked")
    # The best cosine that a pair of block and bucket would need decides whether they meet.
    heads = asked.groupBy(F.col("block").alias("b"), F.col("dim").alias("d")).agg(
        F.min(F.when(F.col("norm2") > 0, F.col("floor") / F.sqrt("norm2")).otherwise(F.lit(float("-inf")))).alias("need"))
    meets = (heads.join(shape.withColumnRenamed("dim", "d2"), (F.col("d") == F.col("d2"))
                        & (F.col("need") <= F.sqrt("longest") * F.lit(1 + 1e-9)))
             .join(start.select(F.col("b").alias("b0"), F.col("bucket").alias("u0")),
                   (F.col("b") == F.col("b0")) & (F.col("bucket") == F.col("u0")), "left_anti"))
    # Neighbours in length share a team; the teams of a dimension are as many as it has buckets for.
    order = F.row_number().over(Window.partitionBy("b", "d").orderBy(F.desc("longest"), "bucket")) - 1
    meets = meets.withColumn("t", F.xxhash64("d", F.floor(order / team))).select("b", "d", "bucket", "t")
    found = found.union(_search(paired(asked, meets), k, bucket, focus, high))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    asked = queries.select(F.col("row").alias("query_row"), "copies")
    return (found.withColumn("rank", rank).where(F.col("rank") <= k)
            .join(asked, "query_row").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select("query_id", "rank", "vec_id", "score"))
