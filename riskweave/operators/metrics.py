"""Validation metrics by stratum (V3-V11, A13, A14): concordance with CI, D, R^2_D,
Brier, all computed on distributed data in one grouped plan per metric.

Strata are data: every row is listed once per stratum it belongs to
("all"/"all", "age"/<age group>, ...), and the stratum columns join the group
keys.  That replaces the study's loop of filter -> collect -> metric -> rbind.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.stats import Z975, r2_from_d
from ..session import materialize
from .common import null_safe_join
from .concordance import concordance, concordance_of_cells, placed_cells
from .cox import d_of_cells

DEFAULT_STRATA = (("age", "age_group"), ("ethnicity", "grp"), ("Townsend", "quint"))


def explode_strata(df: DataFrame, strata: Sequence[tuple[str, str]] = DEFAULT_STRATA,
                   include_all: bool = True) -> DataFrame:
    """One row per (row, stratum) with columns ``x`` (stratum name) and ``var`` (level)."""
    items = ([F.struct(F.lit("all").alias("x"), F.lit("all").alias("var"))] if include_all else [])
    items += [F.struct(F.lit(name).alias("x"), F.col(col).cast("string").alias("var"))
              for name, col in strata]
    return df.select("*", F.inline(F.array(*items)))


def brier(df: DataFrame, by: list[str], score: str = "score", event: str = "death_covid",
          weight: str | None = None) -> DataFrame:
    """V6: mean squared error of the predicted probability (score is in percent)."""
    err = F.pow(F.col(score) / 100.0 - F.col(event), 2)
    base = df.where(F.col(score).isNotNull() & F.col(event).isNotNull())
    if weight:
        val = F.sum(err * F.col(weight)) / F.sum(F.col(weight))
    else:
        val = F.avg(err)
    return base.groupBy(*by).agg(val.alias("brier"))


def _limits(c: DataFrame, by: list[str]) -> DataFrame:
    sd = F.sqrt(F.col("conc_var"))
    return c.select(*by, "n", "events", "con", "dis", "tied", "conc",
                    (F.col("conc") - Z975 * sd).alias("conc_lci"),
                    (F.col("conc") + Z975 * sd).alias("conc_uci"))


def concordance_ci(df: DataFrame, by: list[str], time: str = "t", event: str = "death_covid",
                   score: str = "score", weight: str | None = None) -> DataFrame:
    """V3 + V7: concordance of ``100 - score`` with its normal 95% limits."""
    pred = df.withColumn("_r", F.lit(100.0) - F.col(score))
    return _limits(concordance(pred, by, time, event, "_r", weight), by)


def metrics_table(df: DataFrame, by: list[str], strata=DEFAULT_STRATA, with_d: bool = False,
                  weight: str | None = None, time: str = "t", event: str = "death_covid",
                  score: str = "score") -> DataFrame:
    """V8/V9: metrics per group and stratum (``x``, ``var``).

    Persons are read once: they collapse to cells of equal score, time, event and stratum
    columns, and only cells are listed under each stratum.  An empty table gives no rows."""
    strata = list(strata or ())
    columns = list(dict.fromkeys(c for _, c in strata))
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = df.where(F.col(score).isNotNull() & F.col(event).isNotNull())
    tallied = known.select(*by, *columns, F.col(score).alias("score"), F.col(time).alias("t"), F.col(event).alias("e"), w.alias("_w"))
    tallied = materialize(tallied.groupBy(*by, *columns, "score", "t", "e").agg(
        F.sum("_w").alias("W"), F.sum(F.col("_w") * F.col("_w")).alias("W2"), F.count(F.lit(1)).alias("N")))
    keys = [*by, "x", "var"]
    listed = materialize(explode_strata(tallied, strata).groupBy(*keys, "score", "t", "e")
                         .agg(*[F.sum(c).alias(c) for c in ("W", "W2", "N")]))
    pred = listed.withColumn("r", F.lit(100.0) - F.col("score").cast("double"))
    out = _limits(concordance_of_cells(placed_cells(pred, keys, "t", "e"), keys), keys)
    err = F.pow(F.col("score") / 100.0 - F.col("e"), 2) * F.col("N")
    sums = listed.groupBy(*keys).agg((F.sum(err) / F.sum("N")).alias("brier"))
    out = null_safe_join(out, sums, keys, "left")
    if with_d:
        d = d_of_cells(listed, keys).where("converged")  # a stratum without a finite fit has no D
        lo = F.col("d_stat") - Z975 * F.col("d_se")
        hi = F.col("d_stat") + Z975 * F.col("d_se")
        d = d.select(*keys, "d_stat", lo.alias("d_lci"), hi.alias("d_uci"),
                     r2_from_d(F.col("d_stat")).alias("rsq"),
                     r2_from_d(lo).alias("rsq_lci"), r2_from_d(hi).alias("rsq_uci"))
        out = null_safe_join(out, d, keys, "left")
    return out


def with_labels(m: DataFrame) -> DataFrame:
    """V7: "est (lo to hi)" text columns for whichever metrics are present."""
    out = m.withColumn("conc_ci", labels.est_ci(F.col("conc"), F.col("conc_lci"), F.col("conc_uci")))
    if "d_stat" in m.columns:
        out = (out.withColumn("d_ci", labels.est_ci(F.col("d_stat"), F.col("d_lci"), F.col("d_uci")))
                  .withColumn("rsq_ci", labels.est_ci(F.col("rsq"), F.col("rsq_lci"), F.col("rsq_uci"))))
    return out
