"""Weighted Harrell concordance for right-censored data, with infinitesimal-
jackknife variance, computed without forming pairs.

Definitions (R ``survival::concordance`` for ``Surv(t, e) ~ r``; larger r means
longer predicted survival).  A pair (i, j) is comparable when i has the event
and j outlives i: ``t_j > t_i``, or ``t_j == t_i`` with j censored.  Encoding
``k = 2t + (1 - e)`` makes that exactly ``e_i = 1 and k_j > k_i``.  The pair is
concordant if ``r_j > r_i``, discordant if ``r_j < r_i`` and tied otherwise; it
weighs ``w_i * w_j``.  ``C = (con + tied/2) / (con + dis + tied)``.

Plan.  Rows collapse to *cells* ``(group, r, k)`` with summed weights (ties in
score and time compress a national cohort enormously; a hot score value
collapses to at most one cell per distinct k).  For each probe cell the three
sums over member cells with ``k' > k`` are needed:

* ``above = sum W'`` over ``k' > k``                     (running sum over spans of k)
* ``less, equal = sum W'`` over ``k' > k`` and ``r' < r``, ``r' = r`` (the 2-D part)

The 2-D part uses a dyadic decomposition of k: the set ``{k' > k}`` is the disjoint
union over bits b where k has a 0 of the nodes ``k' >> b == (k >> b) + 1``.  The cells
are range-partitioned by (group, r) once.  Inside a range a task sorts its members by
(node, r) and sums them; what earlier ranges add is the sum of their totals by node, a
table of (range, k) that is listed by level and summed over ranges.  Person rows and
cells are never multiplied, and no step holds a whole group.

The jackknife needs each cell's sums on both sides of a pair, so the same
routine runs a second time with events as members, all cells as probes and k
mirrored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WHOLE_NUMBERS, attach_row, null_safe_join
from .rank import ROWS_PER_RANGE, global_rank, ranges
from .running import running_sums

def cells(df: DataFrame, by: list[str], time: str, event: str, pred: str,
          weight: str | None = None) -> DataFrame:
    """Collapse rows to (by, r, k) with W = sum w, W2 = sum w^2, N = rows."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    tallied = (df.groupBy(*by, F.col(pred).cast("double").alias("r"), F.col(time).alias("_t"), F.col(event).alias("_e"))
               .agg(F.sum(w).alias("W"), F.sum(w * w).alias("W2"), F.count(F.lit(1)).alias("N")))
    return placed_cells(tallied, by)


def placed_cells(tallied: DataFrame, by: list[str], time: str = "_t", event: str = "_e") -> DataFrame:
    """(by, r, k, W, W2, N) from rows already summed by (by, r, time, event).

    ``k`` follows the order of (time, censored after event).  Whole-number times, also
    negative ones, are used as they are; other times by their rank among all times."""
    base = tallied.where(F.col(time).isNotNull() & F.col(event).isNotNull() & F.col("r").isNotNull())
    if dict(tallied.dtypes)[time] not in WHOLE_NUMBERS:
        base = materialize(base)
        places = global_rank(base.select(time).distinct(), [], time, rank_col="_place").select(
            F.col(time).alias("_time"), "_place")
        base = base.join(places, F.col(time) == F.col("_time")).withColumn(time, F.col("_place"))
    k = F.col(time).cast("long") * 2 + 1 - F.col(event).cast("long")
    return base.groupBy(*by, "r", k.alias("k")).agg(*[F.sum(c).alias(c) for c in ("W", "W2", "N")])


def _explode_levels(df: DataFrame, nbits: int, probe: bool) -> DataFrame:
    lv = F.explode(F.sequence(F.lit(0), F.lit(nbits - 1))).alias("lvl")
    x = df.select("*", lv)
    shifted = F.expr("shiftright(k, lvl)")
    if probe:
        x = x.where(shifted.bitwiseAND(F.lit(1)) == 0).withColumn("node", shifted + 1)
    else:
        x = x.withColumn("node", shifted)
    return x


def _inside(nbits: int):
    """Function for one (group, range): of every probe row (typ 0) the weight of the member
    rows (typ 1) with a larger k and a smaller r (less) or the same r (equal).

    Level by level the members are sorted by (node, r); a probe's node is one stretch."""
    def run(t: pa.Table) -> pa.Table:
        member = t.column("typ").to_numpy() == 1
        r, k, w = (t.column(c).to_numpy() for c in ("r", "k", "W"))
        values, place = np.unique(r, return_inverse=True)
        width = len(values)
        mr, mk, mw = place[member], k[member], w[member]
        pr, pk = place[~member], k[~member]
        less, equal = np.zeros(len(pr)), np.zeros(len(pr))
        for b in range(nbits):
            at = np.flatnonzero((pk >> b) & 1 == 0)
            if not len(at) or not len(mk):
                continue
            key = (mk >> b) * width + mr
            order = np.argsort(key, kind="stable")
            key, total = key[order], np.append(0.0, np.cumsum(mw[order]))
            node = ((pk[at] >> b) + 1) * width
            first, here = np.searchsorted(key, node), np.searchsorted(key, node + pr[at])
            past = np.searchsorted(key, node + pr[at], side="right")
            less[at] += total[here] - total[first]
            equal[at] += total[past] - total[here]
        probes = t.filter(pa.array(~member)).drop_columns(["typ", "W"])
        return probes.append_column("_in", pa.array(less)).append_column("equal", pa.array(equal))

    return run


def dominance(members: DataFrame, probes: DataFrame, by: list[str], nbits: int) -> DataFrame:
    """For every distinct probe (by, r, k): member weight with k' > k split by r' vs r.

    ``members`` has (by, rb, r, k, W); ``probes`` has (by, rb, r, k), where rb is the
    range of (by, r).  Returns (by, r, k, less, equal, above)."""
    m = members.select(*by, "rb", "r", "k", F.lit(1).alias("typ"), F.col("W").cast("double").alias("W"))
    p = probes.select(*by, "rb", "r", "k").distinct().select("*", F.lit(0).alias("typ"), F.lit(0.0).alias("W"))

    # inside a range of r: one task has its cells, as many as a range holds
    kinds = ", ".join(f"`{c}` {t}" for c, t in p.drop("typ", "W").dtypes)
    within = m.unionByName(p).groupBy(*by, "rb").applyInArrow(_inside(nbits), f"{kinds}, _in double, equal double")

    # earlier ranges: their totals by node, summed over ranges
    node = [*by, "lvl", "node"]
    totals = _explode_levels(m.groupBy(*by, "rb", "k").agg(F.sum("W").alias("W")), nbits, probe=False)
    totals = totals.groupBy(*node, "rb").agg(F.sum("W").alias("W"))
    asked = _explode_levels(p.select(*by, "rb", "k").distinct(), nbits, probe=True)
    w_off = Window.partitionBy(*node).orderBy("rb", "typ").rowsBetween(Window.unboundedPreceding, 0)
    before = (totals.select(*node, "rb", F.lit(1).alias("typ"), "W", F.lit(None).cast("long").alias("k"))
              .unionByName(asked.select(*node, "rb", F.lit(0).alias("typ"), F.lit(0.0).alias("W"), "k"))
              .withColumn("_off", F.sum("W").over(w_off)).where("typ = 0")
              .groupBy(*by, "rb", "k").agg(F.sum("_off").alias("_off")))

    # above: k' > k within the group, summed over spans of k
    both = (m.unionByName(p).groupBy(*by, "k").agg(F.sum("W").alias("W"))
            .withColumn("_range", F.shiftright("k", nbits // 2)))
    above = running_sums(both, by, "k", {"above": "W"}, reverse=True, inclusive=False).select(*by, "k", "above")

    out = null_safe_join(within, before, [*by, "rb", "k"], "left")
    out = null_safe_join(out, above, [*by, "k"], "left")
    return out.select(*by, "r", "k", (F.col("_in") + F.coalesce("_off", F.lit(0.0))).alias("less"), "equal",
                      F.coalesce("above", F.lit(0.0)).alias("above"))


def concordance(df: DataFrame, by: list[str], time: str = "t", event: str = "death_covid",
                pred: str = "r", weight: str | None = None, variance: bool = True,
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """V3: per group ``con, dis, tied`` (weighted pair counts), ``conc`` and ``conc_var``.

    Groups with no comparable pair get a null concordance; an empty table gives no rows
    (without group keys one row of zero counts)."""
    return concordance_of_cells(cells(df, by, time, event, pred, weight), by, variance, rows_per_range)


def concordance_of_cells(cells_: DataFrame, by: list[str], variance: bool = True,
                         rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``concordance`` from the frame that ``cells`` gives, or sums of it."""
    c = ranges(materialize(cells_), [*by, "r"], "rb", rows_per_range)
    min_k, max_k = (k or 0 for k in c.agg(F.min("k"), F.max("k")).first())
    first = min_k // 2 * 2
    c = c.withColumn("k", F.col("k") - F.lit(first))
    nbits = max(1, int(max_k - first).bit_length())
    kmax = (1 << nbits) - 1

    ev = c.where(F.col("k") % 2 == 0)
    # used by the totals and again by the jackknife: compute once
    di = dominance(c, ev, by, nbits)
    if variance:
        di = materialize(di)
    pi = null_safe_join(ev.select(*by, "r", "k", "W"), di, [*by, "r", "k"])
    totals = (pi.groupBy(*by)
              .agg(F.sum(F.col("W") * (F.col("above") - F.col("less") - F.col("equal"))).alias("con"),
                   F.sum(F.col("W") * F.col("less")).alias("dis"),
                   F.sum(F.col("W") * F.col("equal")).alias("tied")))
    counts = c.groupBy(*by).agg(F.sum("N").alias("n"),
                                F.sum(F.when(F.col("k") % 2 == 0, F.col("N")).otherwise(0)).alias("events"),
                                F.sum("W").alias("sum_w"))
    res = null_safe_join(counts, totals, by, "left") if by else attach_row(counts, totals)
    res = (res.withColumn("con", F.coalesce("con", F.lit(0.0)))
              .withColumn("dis", F.coalesce("dis", F.lit(0.0)))
              .withColumn("tied", F.coalesce("tied", F.lit(0.0)))
              .withColumn("pairs", F.col("con") + F.col("dis") + F.col("tied"))
              .withColumn("conc", F.try_divide(F.col("con") + F.col("tied") / 2, F.col("pairs"))))
    if not variance:
        return res
    res = materialize(res)  # one row per group; joined twice below

    mirror = lambda d: d.withColumn("k", F.lit(kmax) - F.col("k"))
    dj = dominance(mirror(ev), mirror(c), by, nbits)
    dj = dj.withColumn("k", F.lit(kmax) - F.col("k"))
    cell_i = di.select(*by, "r", "k", (F.col("above") - F.col("less") - F.col("equal")).alias("con_i"),
                       F.col("less").alias("dis_i"), F.col("equal").alias("tie_i"))
    cell_j = dj.select(*by, "r", "k", F.col("less").alias("con_j"),
                       (F.col("above") - F.col("less") - F.col("equal")).alias("dis_j"),
                       F.col("equal").alias("tie_j"))
    per = null_safe_join(c.select(*by, "r", "k", "W2"), cell_i, [*by, "r", "k"], "left")
    per = null_safe_join(per, cell_j, [*by, "r", "k"], "left").fillna(
        0.0, subset=["con_i", "dis_i", "tie_i", "con_j", "dis_j", "tie_j"])
    per = null_safe_join(per, res.select(*by, "conc", "pairs"), by) if by else \
        attach_row(per, res.select("conc", "pairs"))
    con_m = F.col("con_i") + F.col("con_j")
    dis_m = F.col("dis_i") + F.col("dis_j")
    tie_m = F.col("tie_i") + F.col("tie_j")
    infl = F.try_divide(con_m + tie_m / 2 - F.col("conc") * (con_m + dis_m + tie_m), F.col("pairs"))
    v = per.groupBy(*by).agg(F.sum(F.col("W2") * infl * infl).alias("conc_var"))
    return null_safe_join(res, v, by, "left") if by else attach_row(res, v)
