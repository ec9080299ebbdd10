"""G1: exact rank / NTILE over a whole group without a single-partition window.

``F.ntile().over(Window.partitionBy("sex","period").orderBy(...))`` sends each
group to one task: with four groups and a national cohort that is four tasks
holding everything.  Here the rows are range-partitioned by (group, order key,
tie-break), as a global sort would do, so any key type works, split points are
those of each group, and a hot tie is cut by its tie-break.  The number of ranges
follows the number of rows and has no cap.  Row numbers are computed inside each
(range, group) and shifted by the counts of the group's earlier ranges, a table
with about one row per range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions
from .common import null_safe_join

ROWS_PER_RANGE = 250_000       # target rows per window partition


def ranges(df: DataFrame, keys: list, out: str = "_range", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Range-partition by ``keys`` and keep the number of each row's range in ``out``.

    The result is written once: the split points are sampled, so the numbers must not
    be computed twice.  Ranges are in key order; rows with equal keys share one."""
    n = max(shuffle_partitions(df.sparkSession), df.count() // rows_per_range + 1)
    return materialize(df.repartitionByRange(n, *keys).withColumn(out, F.spark_partition_id()))


def global_rank(df: DataFrame, by: list[str], order: str, tiebreak: str | None = None,
                rank_col: str = "rank", size_col: str = "n_group", keep_nulls: bool = False,
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Exact 1-based rank of each row within ``by`` ordered by (order, tiebreak), plus
    the group size.  Rows with a null ``order`` are ranked last if ``keep_nulls`` is
    set and dropped otherwise; a null tie-break comes last among its ties."""
    by = list(by)
    src = materialize(df if keep_nulls else df.where(F.col(order).isNotNull()))
    sort = [F.col(c).asc_nulls_last() for c in [order, *([tiebreak] if tiebreak else [])]]
    placed = ranges(src, [*[F.col(c).asc() for c in by], *sort], "_range", rows_per_range)
    counts = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_c"))
    whole = Window.partitionBy(*by)
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, "_range", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"),
                            F.sum("_c").over(whole).alias(size_col))
    joined = null_safe_join(placed, offsets, [*by, "_range"])
    here = Window.partitionBy(*by, "_range").orderBy(*sort)
    return joined.withColumn(rank_col, F.col("_off") + F.row_number().over(here)).drop("_range", "_off")


def ntile_from_rank(rank: str, size: str, k: int):
    """NTILE arithmetic: n rows, k tiles; the first n mod k tiles hold one extra row."""
    return F.expr(
        f"""CASE WHEN {rank} <= ({size} % {k}) * ({size} div {k} + 1)
                 THEN ({rank} - 1) div ({size} div {k} + 1) + 1
                 ELSE ({size} % {k}) + ({rank} - ({size} % {k}) * ({size} div {k} + 1) - 1)
                      div ({size} div {k}) + 1 END""").cast("int")


def scalable_ntile(df: DataFrame, by: list[str], order: str, tiebreak: str, k: int,
                   out: str = "q", keep_nulls: bool = True, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """NTILE(k) within ``by`` ordered by (order, tiebreak), exact and skew-safe.

    Rows with a null ``order`` get a null tile (R ``ntile`` semantics) instead of
    being mixed into the first tile as SQL NTILE would do.
    """
    ranked = global_rank(df, by, order, tiebreak, "_rank", "_n", rows_per_range=rows_per_range)
    tiled = ranked.withColumn(out, ntile_from_rank("_rank", "_n", k)).drop("_rank", "_n")
    if not keep_nulls:
        return tiled
    nulls = df.where(F.col(order).isNull()).withColumn(out, F.lit(None).cast("int"))
    return tiled.unionByName(nulls)


def global_row_number(df: DataFrame, order_by: list[str], out: str = "row") -> DataFrame:
    """A 1-based row number over the whole frame without a single-partition sort.
    Every row is numbered; null keys come last."""
    order = order_by[0]
    tiebreak = order_by[1] if len(order_by) > 1 else None
    return global_rank(df, [], order, tiebreak, out, "_n", keep_nulls=True).drop("_n")
