"""Royston-Sauerbrei D statistic on the full cohort.

1. Rows collapse to cells (group, score, t, event) with summed weights, and these to the
   number of rows of each (group, score).  The ranks of tied rows are consecutive, so a
   running count over the scores gives all ranks, and no person is sorted.
2. Rankits ``z = inv_norm((rank - 3/8) / (n + 1/4)) / kappa`` are averaged over the ranks
   of a tied score, in blocks of ranks, so a hot tie is no hot task.
3. A one-covariate Cox model ``Surv(t, event) ~ z`` is fitted per group by Newton-Raphson.
   Each iteration is one distributed job: sums per (group, day), reverse running sums by
   ranges of days (``running``), Efron's tie sums in closed form, and one row per group,
   which is all that reaches the driver.  D is the coefficient, its standard error
   ``I(beta)^-1/2``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import KAPPA, inv_norm
from ..session import materialize
from .common import WHOLE_NUMBERS, keyed_join, null_safe_join
from .rank import ROWS_PER_RANGE, ranges
from .running import running_sums

RANKS = 4096   # of a tied score that are listed in one row
SPAN = 1024    # days in a range
STEPWISE = 32  # deaths of a day whose tie terms are added one by one


def rankits(counts: DataFrame, by: list[str], score: str, n: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(by, score, z): scaled normal scores averaged over tied scores, from the number of
    rows ``n`` of each (by, score)."""
    placed = ranges(materialize(counts.select(*by, score, n)), [*by, score], rows_per_range=rows_per_range)
    placed = running_sums(placed, by, score, {"_before": n}, inclusive=False, totals={"_all": "_before"})
    block = F.sequence(F.lit(0).cast("long"), F.expr(f"({n} - 1) div {RANKS}"))
    listed = placed.select(*by, score, n, "_before", "_all", F.explode(block).alias("_block"))
    listed = listed.repartition(*by, score, "_block")  # a hot tie's blocks go to many tasks
    rank = F.sequence(F.col("_block") * RANKS + 1, F.least(F.col(n), (F.col("_block") + 1) * RANKS))
    listed = listed.select(*by, score, "_before", "_all", F.explode(rank).alias("_r"))
    z = inv_norm((F.col("_before") + F.col("_r") - 0.375) / (F.col("_all") + 0.25)) / KAPPA
    return listed.withColumn("_z", z).groupBy(*by, score).agg(F.avg("_z").alias("z"))


def with_tie_sums(days: DataFrame) -> DataFrame:
    """Add ``logs``, ``ones`` and ``twos``: the sums of log(q - k), 1 / (q - k) and
    1 / (q - k)^2 for k = 0 .. d - 1 and q = d * s0 / e0, which is d or more.

    The last STEPWISE terms, where q - k may be small, are added one by one, those before
    by the Euler-Maclaurin formula, whose error there is below 1e-12; so the work does not
    grow with d.  The formula runs from ``low``, the least argument of the other terms, to q."""
    x = days.selectExpr("*", "d * s0 / e0 AS q", f"least(d, {STEPWISE}L) AS few")
    x = x.selectExpr("*", "d - few - 1 AS steps", "q - (d - few - 1) AS low", "d > few AS more", """
        aggregate(sequence(d - few, d - 1), struct(0D AS l, 0D AS a, 0D AS b), (s, k) -> struct(
            s.l + ln(q - k) AS l, s.a + 1 / (q - k) AS a, s.b + 1 / ((q - k) * (q - k)) AS b)) AS last""")
    x = x.selectExpr("*", "-log1p(-steps / q) AS apart")  # log(q / low)
    x = x.selectExpr(
        *days.columns,
        """last.l + if(more, steps * ln(q) + low * apart - steps + (ln(low) + ln(q)) / 2 + (1 / q - 1 / low) / 12
           - (power(q, -3) - power(low, -3)) / 360 + (power(q, -5) - power(low, -5)) / 1260, 0D) AS logs""",
        """last.a + if(more, apart + (1 / low + 1 / q) / 2 + (power(low, -2) - power(q, -2)) / 12
           - (power(low, -4) - power(q, -4)) / 120 + (power(low, -6) - power(q, -6)) / 252, 0D) AS ones""",
        """last.b + if(more, steps / (low * q) + (power(low, -2) + power(q, -2)) / 2 + (power(low, -3) - power(q, -3)) / 6
           - (power(low, -5) - power(q, -5)) / 30 + (power(low, -7) - power(q, -7)) / 42, 0D) AS twos""")
    return x


def _tied(risk: DataFrame, by: list[str], ties: str) -> DataFrame:
    """Log-likelihood, score U and information I of each group, from its days with events.

    Efron takes a day's d events out of the risk set in part, one after another: S_j less
    k/d of the events' sum is linear in k, so S_j / S_0 is the events' mean plus what the
    others differ from it, over q - k."""
    names = ["`" + c + "`" for c in by]
    if ties == "breslow":
        x = risk.selectExpr(*names, "_beta", "ez", "dw * ln(s0) AS l", "dw * s1 / s0 AS m", "dw * (s2 / s0 - s1 * s1 / (s0 * s0)) AS v")
    else:
        x = with_tie_sums(risk).selectExpr(
            "*", "dw / d AS w", "e1 / e0 AS own1", "e2 / e0 AS own2", "(s1 - s0 * e1 / e0) * d / e0 AS away1",
            "(s2 - s0 * e2 / e0) * d / e0 AS away2")
        x = x.selectExpr(
            *names, "_beta", "ez", "w * (logs + d * ln(e0 / d)) AS l", "w * (d * own1 + away1 * ones) AS m",
            "w * (d * own2 + away2 * ones - d * own1 * own1 - 2 * own1 * away1 * ones - away1 * away1 * twos) AS v")
    return x.groupBy(*by).agg(F.expr("sum(_beta * ez - l) AS ll"), F.expr("sum(ez - m) AS u"), F.expr("sum(v) AS info"))


def _step(cells: DataFrame, beta: DataFrame, by: list[str], time: str, event: str, z: str, weight: str,
          count: str, ties: str) -> DataFrame:
    """Log-likelihood, score U and information I of each group at its ``_beta``: sums per
    day, reverse running sums over ranges of days, tie sums, and one row a group."""
    x = keyed_join(cells, beta, by).selectExpr(
        *["`" + c + "`" for c in by], "_beta", "_range", f"{time} AS _t", f"{weight} AS w", f"{z} AS zz", f"{count} AS n",
        f"{weight} * exp(_beta * {z}) AS ww", f"{event} = 1 AS died")
    sums = {"a0": "ww", "a1": "ww * zz", "a2": "ww * zz * zz"}
    sums |= {f"e{k}": f"if(died, {v}, 0D)" for k, v in enumerate(sums.values())}
    sums |= {"dw": "if(died, w, 0D)", "ez": "if(died, w * zz, 0D)", "d": "if(died, n, 0L)"}
    days = x.groupBy(*by, "_beta", "_range", "_t").agg(*[F.expr(f"sum({v}) AS {k}") for k, v in sums.items()])
    # one shuffle by range serves the sums within ranges and the ranges' totals
    days = days.repartition(*by, "_range")
    risk = running_sums(days, by, "_t", {f"s{k}": f"a{k}" for k in range(3)}, reverse=True).where("d > 0")
    return _tied(risk, by, ties)


def by_days(cells: DataFrame, by: list[str], time: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``cells``, written once, with ``_range``: spans of SPAN days where times are whole
    numbers, else ranges of (by, time)."""
    cells = materialize(cells)
    if dict(cells.dtypes)[time] in WHOLE_NUMBERS:
        return cells.withColumn("_range", F.floor(F.col(time) / SPAN))
    return ranges(cells, [*by, time], rows_per_range=rows_per_range)


def cox1(cells: DataFrame, by: list[str], z: str = "z", time: str = "t", event: str = "e",
         weight: str = "W", count: str = "N", ties: str = "efron", max_iter: int = 30,
         tol: float = 1e-10) -> DataFrame:
    """One-covariate Cox fit per group over pre-aggregated cells, whose column ``_range``
    numbers ranges of (by, time) (one is made if there is none).

    Returns (by..., coef, se, loglik, iterations, converged).  A group without events or
    without spread has a null coef; a fit that stops at ``max_iter`` has converged =
    false and a null se.  Three numbers a group and iteration reach the driver."""
    spark = cells.sparkSession
    if "_range" not in cells.columns:
        cells = by_days(cells, by, time)
    gkeys = [tuple(r) for r in cells.select(*by).distinct().collect()] if by else [()]
    beta = {g: 0.0 for g in gkeys}
    last: dict = {g: None for g in gkeys}
    done: dict = {}
    schema = ", ".join([f"`{c}` {t}" for c, t in cells.select(*by).dtypes] + ["_beta double"])
    it = 0
    while it < max_iter and len(done) < len(gkeys):
        it += 1
        active = [g for g in gkeys if g not in done]
        now = spark.createDataFrame([(*g, float(beta[g])) for g in active], schema)
        found = {tuple(r[c] for c in by): r
                 for r in _step(cells, now, by, time, event, z, weight, count, ties).collect()}
        for g in active:
            r = found.get(g)
            if r is None or r["info"] is None or not r["info"] > 0 or not math.isfinite(r["info"]):
                done[g] = (None, None, r and r["ll"], it, True)
                continue
            prev = last[g]
            if prev is not None and r["ll"] < prev[0] - 1e-9 * (1 + abs(prev[0])):
                beta[g] = (beta[g] + prev[1]) / 2  # a step too far is halved
                continue
            step = r["u"] / r["info"]
            last[g] = (r["ll"], beta[g])
            if abs(step) < tol:
                done[g] = (beta[g], 1.0 / math.sqrt(r["info"]), r["ll"], it, True)
                continue
            beta[g] = beta[g] + step
    for g in gkeys:
        if g not in done:
            done[g] = (beta[g], None, last[g][0] if last[g] else None, it, False)
    out_schema = schema.replace(
        "_beta double", "coef double, se double, loglik double, iterations int, converged boolean")
    return spark.createDataFrame([(*g, *done[g]) for g in gkeys], out_schema)


def d_statistic(df: DataFrame, by: list[str], time: str = "t", event: str = "death_covid",
                score: str = "score", weight: str | None = None, ties: str = "efron") -> DataFrame:
    """V4: D (Cox coefficient on scaled rankits) and its standard error per group; an
    empty table gives no rows."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    cells = df.groupBy(*by, F.col(score).alias("score"), F.col(time).alias("t"), F.col(event).alias("e")).agg(
        F.sum(w).alias("W"), F.count(F.lit(1)).alias("N"))
    return d_of_cells(cells, by, ties)


def d_of_cells(cells: DataFrame, by: list[str], ties: str = "efron", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``d_statistic`` from rows summed by (by, score, t, e), with weight W and count N."""
    cells = materialize(cells.where("score IS NOT NULL AND t IS NOT NULL AND e IS NOT NULL"))
    z = rankits(cells.groupBy(*by, "score").agg(F.sum("N").alias("n")), by, "score", "n", rows_per_range)
    c = null_safe_join(cells, z, [*by, "score"]).select(*by, "z", "t", "e", "W", "N")
    fit = cox1(by_days(c, by, "t", rows_per_range), by, ties=ties)
    return fit.select(*by, F.col("coef").alias("d_stat"), F.col("se").alias("d_se"), "converged")
