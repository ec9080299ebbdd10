"""Connected components of a table of edges, by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import snapshot


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b): root is the smallest vertex
    reachable from v.  Direction, repeated edges and loops don't matter; null ends are
    not vertices.

    Each round hangs larger neighbours onto the smallest neighbour, then smaller ones
    onto it, until the edges are stars.  Minima are pre-aggregated and hot vertices
    meet their neighbours in ordinary joins, which adaptive execution splits.  Rounds
    are written to the shared folder; only a count and a checksum reach the driver."""
    edges = snapshot(edges.where("a != b").select("a", "b").distinct(), name)
    before = None
    while True:
        both = edges.union(edges.select("b", "a"))
        low = (both.groupBy("a").agg(F.min("b").alias("m"))
               .select(F.col("a").alias("v"), F.least("a", "m").alias("m")))
        large = (both.where("b > a").join(low, F.col("a") == F.col("v"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")))  # each larger neighbour to the least
        large = snapshot(large.where("a != b").distinct(), name)
        # Every edge now runs from a larger to a smaller end.
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "v")
        small = (large.join(low, F.col("a") == F.col("v"))
                 .select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b"))
        edges = snapshot(small.where("a != b").distinct(), name)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
    loops = edges.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(loops)
