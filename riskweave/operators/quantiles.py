"""Quantile products: threshold/capture tables, top centiles, calibration
(W1-W4, A10, A11, R1, O1-O3, V12-V14).

Person-level work is the exact NTILE of ``rank.scalable_ntile``; everything
after it runs on at most ``k`` rows per group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rank import scalable_ntile


def quantile_groups(scored: DataFrame, by: list[str], k: int, score: str = "score",
                    event: str = "death_covid", tiebreak: str = "person_id") -> DataFrame:
    """Per (group, tile) min score, deaths, total, mean predicted, % observed."""
    tiled = scalable_ntile(scored.select(*by, tiebreak, score, event), by, score, tiebreak, k,
                           "q", keep_nulls=False)
    return (tiled.groupBy(*by, "q")
            .agg(F.min(score).alias("min"),
                 F.sum(event).cast("long").alias("deaths"),
                 F.count(F.lit(1)).alias("total"),
                 F.avg(score).alias("predicted"),
                 (F.avg(event) * 100.0).alias("observed")))


def capture(groups: DataFrame, by: list[str]) -> DataFrame:
    """Cumulative deaths from the top tile down and their share."""
    w_part = Window.partitionBy(*by) if by else Window.partitionBy()
    w_cum = w_part.orderBy(F.desc("q")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (groups
            .withColumn("cum_deaths", F.sum("deaths").over(w_cum).cast("long"))
            .withColumn("cum_deaths_p", F.try_divide(F.col("cum_deaths").cast("double"),
                                                     F.sum("deaths").over(w_part).cast("double"))))


def threshold_table(scored: DataFrame, by: list[str], k: int = 20, **kw) -> DataFrame:
    """Risk-threshold table by tile with cumulative capture."""
    g = quantile_groups(scored, by, k, **kw)
    return capture(g, by).select(*by, "q", "min", "deaths", "total", "cum_deaths", "cum_deaths_p")


def top_centiles(scored: DataFrame, by: list[str], k: int = 100, min_q: int = 75, **kw) -> DataFrame:
    """Centile capture table restricted to the top tiles."""
    return threshold_table(scored, by, k, **kw).where(F.col("q") >= min_q)


def calibration(scored: DataFrame, by: list[str], k: int = 20, **kw) -> DataFrame:
    """V14 (wide): mean predicted vs observed percentage per tile."""
    return quantile_groups(scored, by, k, **kw).select(*by, "q", "predicted", "observed")


def calibration_long(scored: DataFrame, by: list[str], k: int = 20, **kw) -> DataFrame:
    """Wide -> long (type Predicted / Observed, value)."""
    wide = calibration(scored, by, k, **kw).select(
        *by, "q", F.col("predicted").alias("Predicted"), F.col("observed").alias("Observed"))
    return wide.unpivot([*by, "q"], ["Predicted", "Observed"], "type", "value")


def flip_top(table: DataFrame, k: int = 100, sex_labels: dict | None = None) -> DataFrame:
    """``q -> k - q + 1`` (top centile = 1) and optional sex relabel."""
    out = table.withColumn("q", (F.lit(k) - F.col("q") + 1).cast("int"))
    if sex_labels:
        lab = None
        for s, name in sex_labels.items():
            lab = F.when(F.col("sex") == s, name) if lab is None else lab.when(F.col("sex") == s, name)
        out = out.withColumn("sex_label", lab)
    return out
