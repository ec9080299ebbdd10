"""Grouped least squares from sufficient statistics.

One aggregation gives every group its Gram matrix: the sums of products of the design's
columns with each other and with the response.  It holds all that a linear model needs,
so fitting, standard errors and hold-out errors of any number of groups cost one scan,
and a group is a small dense solve inside a task, never a job of its own.

Numeric columns are centred and scaled by whole-table moments before they are multiplied,
which spans the same model (main effects stand beside their interactions) and keeps the
products' sums accurate.  A text column has one indicator for each level; columns that
are sums of columns before them are dropped while solving, as are levels that a group
does not have.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import null_safe_join, per_group

MAX_COLUMNS = 512      # of a design, which bounds a group's matrix to 2 MB
HELD_GROUPS = 64       # matrices that a task keeps before it hands them on
TOLERANCE = 1e-9       # share of a column that must be left by the columns before it


@dataclass(frozen=True)
class Design:
    """Columns of a linear model: the intercept, numeric features, levels of text features,
    and their products with ``interact``."""

    numeric: tuple[tuple[str, float, float], ...]      # name, mean, standard deviation
    levels: tuple[tuple[str, tuple[str, ...]], ...]    # name, levels with the reference last
    interact: str | None
    centre: float                                      # mean of the response

    @property
    def terms(self) -> list[str]:
        main = [n for n, _, _ in self.numeric] + [f"{n}={v}" for n, vs in self.levels for v in vs]
        return ["(Intercept)", *main, *[f"{self.interact}:{m}" for m in main if self.interact and m != self.interact]]

    @property
    def is_level(self) -> np.ndarray:
        """Which columns are 0 for all rows of a group that lacks a level."""
        main = [False] * len(self.numeric) + [True] * sum(len(vs) for _, vs in self.levels)
        names = [n for n, _, _ in self.numeric]
        more = [x for k, x in enumerate(main) if self.interact and not (k < len(names) and names[k] == self.interact)]
        return np.array([False, *main, *more])

    def column(self) -> Column:
        """The row's values as one array, null if a feature is null or a level not among
        those of the design."""
        main = [(F.col(n).cast("double") - F.lit(m)) / F.lit(s) for n, m, s in self.numeric]
        names = [n for n, _, _ in self.numeric]
        main += [(F.col(n) == F.lit(v)).cast("double") for n, vs in self.levels for v in vs]
        by = main[names.index(self.interact)] if self.interact else None
        more = [by * x for k, x in enumerate(main) if self.interact and not (k < len(names) and names[k] == self.interact)]
        known = [F.col(n).isNotNull() for n in names] + [F.coalesce(F.col(n).isin(*vs), F.lit(False)) for n, vs in self.levels]
        ok = F.lit(True)
        for k in known:
            ok = ok & k
        return F.when(ok, F.array(F.lit(1.0), *main, *more))

    def to_raw(self) -> np.ndarray:
        """Matrix that turns coefficients of the scaled columns into those of the plain ones."""
        terms = self.terms
        at = {t: k for k, t in enumerate(terms)}
        scale = {n: (m, s) for n, m, s in self.numeric}
        out = np.zeros((len(terms), len(terms)))
        out[0, 0] = 1
        split = {t: (self.interact, t[len(self.interact) + 1:]) for t in terms[1:]
                 if self.interact and t.startswith(self.interact + ":") and t[len(self.interact) + 1:] in at}
        for t in terms[1:]:
            if t not in split:
                m, s = scale.get(t, (0.0, 1.0))
                out[at[t], at[t]], out[0, at[t]] = 1 / s, -m / s
                continue
            a, b = split[t]
            (ma, sa), (mb, sb) = scale[a], scale.get(b, (0.0, 1.0))
            out[at[t], at[t]] = 1 / (sa * sb)
            out[at[a], at[t]] -= mb / (sa * sb)
            out[at[b], at[t]] -= ma / (sa * sb)
            out[0, at[t]] += ma * mb / (sa * sb)
        return out


def design(df: DataFrame, value: str, features: Sequence[str], interact: str | None = None,
           max_columns: int = MAX_COLUMNS) -> Design:
    """L1: the design of ``value`` on ``features`` (text columns by level) and, if named,
    on the products of all of them with the numeric feature ``interact``.

    One aggregation over the rows with a value; the levels of the text columns reach the
    driver only if the design has no more than ``max_columns`` columns."""
    kinds = dict(df.dtypes)
    text = [c for c in features if kinds[c] == "string"]
    numbers = [c for c in features if c not in text]
    if interact is not None and interact not in numbers:
        raise ValueError(f"interactions are with a numeric feature, not {interact!r}")
    known = df.where(F.col(value).isNotNull())
    x = lambda c: F.col(c).cast("double")
    moments = [F.avg(x(value)).alias("y")]
    moments += [f(x(c)).alias(f"{n}{k}") for k, c in enumerate(numbers) for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    counts = [F.approx_count_distinct(F.col(c)).alias(f"d{k}") for k, c in enumerate(text)]
    row = known.agg(*moments, *counts).first()
    if sum(row[f"d{k}"] for k in range(len(text))) > 2 * max_columns:
        raise ValueError(f"text features have too many levels for {max_columns} columns")
    levels = []
    for k, c in enumerate(text):  # few by the count above
        found = sorted(r[0] for r in known.where(F.col(c).isNotNull()).select(c).distinct().limit(max_columns + 1).collect())
        levels.append((c, (*found[1:], *found[:1])))
    numeric = tuple((c, row[f"m{k}"] or 0.0, row[f"s{k}"] or 1.0) for k, c in enumerate(numbers))
    made = Design(numeric, tuple(levels), interact, row["y"] or 0.0)
    if len(made.terms) > max_columns:
        raise ValueError(f"the design has {len(made.terms)} columns, the limit is {max_columns}")
    return made


def grams(df: DataFrame, made: Design, value: str, by: Sequence[str]) -> DataFrame:
    """(by..., gram): upper triangle, row by row, of the sums of products of the design's
    columns and the centred value, over rows where all of them are known.

    A task adds up its own rows by group before anything is shuffled; null group keys
    are a group."""
    width = len(made.terms) + 1
    upper = np.triu_indices(width)
    kinds = dict(df.dtypes)
    rows = df.select(*by, made.column().alias("_x"), (F.col(value).cast("double") - F.lit(made.centre)).alias("_y"))
    rows = rows.where(F.col("_x").isNotNull() & F.col("_y").isNotNull())

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def hand_on():
            keys = list(held)
            columns = [pa.array([k[j] for k in keys], kind) for j, kind in enumerate(types)]
            sums = pa.array([held[k][upper] for k in keys], pa.list_(pa.float64()))
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, sums], [*by, "sums"])

        for b in batches:
            if not b.num_rows:
                continue
            types = [b.schema.field(j).type for j in range(len(by))]
            x = b.column(len(by)).flatten().to_numpy().reshape(b.num_rows, width - 1)
            x = np.column_stack([x, b.column(len(by) + 1).to_numpy()])
            groups: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(*(b.column(j).to_pylist() for j in range(len(by))))) if by else ((0, ()),):
                groups.setdefault(key, []).append(k)
            for key, at in groups.items():
                mine = x[at] if by else x
                held[key] = held.get(key, 0.0) + mine.T @ mine
                if len(held) >= HELD_GROUPS:
                    yield hand_on()
        if held:
            yield hand_on()

    keys = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    parts = rows.mapInArrow(run, f"{keys}{', ' if by else ''}sums array<double>")
    sums = (parts.select(*by, F.posexplode("sums").alias("_k", "_v")).groupBy(*by, "_k").agg(F.sum("_v").alias("_v")))
    return sums.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s["_v"]).alias("gram"))


def _square(flat: np.ndarray) -> np.ndarray:
    width = int((math.isqrt(8 * len(flat) + 1) - 1) // 2)
    out = np.zeros((width, width))
    out[np.triu_indices(width)] = flat
    return out + np.triu(out, 1).T


def sweep(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """(coefficients, inverse, residual sum of squares, kept) from a Gram matrix whose last
    column is the response.  Columns that those before them explain have coefficient 0."""
    a = gram.copy()
    p = len(a) - 1
    kept = np.zeros(p, bool)
    for k in range(p):
        if a[k, k] <= TOLERANCE * max(gram[k, k], 1e-300):
            continue
        kept[k] = True
        pivot, column = a[k, k], a[:, k].copy()
        a -= np.outer(column, column) / pivot
        a[k, :] = a[:, k] = column / pivot
        a[k, k] = -1 / pivot
    use = np.flatnonzero(kept)
    beta, inverse = np.zeros(p), np.zeros((p, p))
    beta[use] = a[use, p]
    inverse[np.ix_(use, use)] = -a[np.ix_(use, use)]
    return beta, inverse, max(float(a[p, p]), 0.0), kept


def t_tail(t: float, df: float) -> float:
    """P(|T| > |t|) of Student's t: the incomplete beta function by its continued fraction."""
    if not math.isfinite(t):
        return 0.0 if math.isinf(t) else math.nan
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    if a > 100:  # log gamma(a + 1/2) - log gamma(a), whose terms would cancel
        ratio = 0.5 * math.log(a) - 1 / (8 * a) + 1 / (192 * a ** 3) - 1 / (640 * a ** 5)
    else:
        ratio = math.lgamma(a + b) - math.lgamma(a)
    front = math.exp(ratio - math.lgamma(b) - a * math.log1p(t * t / df) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _fraction(b, a, 1 - x) / b
    return front * _fraction(a, b, x) / a


def _fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def fits(sums: DataFrame, made: Design) -> DataFrame:
    """L2: ``sums`` of grams() with n, rank, sse, sst, r2, beta and lacking (the columns of
    levels that the group does not have)."""
    is_level = made.is_level

    @F.arrow_udf("struct<n:bigint,rank:int,sse:double,sst:double,beta:array<double>,lacking:array<int>>")
    def solve(column: pa.Array) -> pa.Array:
        out = []
        for flat in column:
            gram = _square(flat.values.to_numpy())
            beta, _, sse, kept = sweep(gram)
            sst = gram[-1, -1] - gram[0, -1] ** 2 / gram[0, 0]
            out.append((round(gram[0, 0]), int(kept.sum()), sse, max(float(sst), 0.0), beta.tolist(),
                        np.flatnonzero(is_level & (np.diag(gram)[:-1] == 0)).tolist()))
        kind = pa.struct([("n", pa.int64()), ("rank", pa.int32()), ("sse", pa.float64()), ("sst", pa.float64()),
                          ("beta", pa.list_(pa.float64())), ("lacking", pa.list_(pa.int32()))])
        return pa.array([dict(zip([f.name for f in kind], r)) for r in out], kind)

    fit = sums.withColumn("_fit", solve("gram"))
    keep = [c for c in sums.columns if c != "gram"]
    return fit.select(*keep, "_fit.*").withColumn("r2", F.try_divide(F.col("sst") - F.col("sse"), F.col("sst")))


def predicted(df: DataFrame, fit: DataFrame, made: Design, by: Sequence[str], out: str) -> DataFrame:
    """L3: ``df`` with the fitted value of its group's model; null where a feature is null,
    where the group has no model, and for a level that the group's model has not seen."""
    models = per_group(fit.select(*by, F.struct("beta", "lacking").alias("_model")))
    joined = null_safe_join(df, models, list(by), "left").withColumn("_x", made.column())
    dot = F.aggregate(F.zip_with("_x", "_model.beta", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    unseen = F.exists("_model.lacking", lambda k: F.get("_x", k) != 0)
    return joined.withColumn(out, F.when(~unseen, dot + F.lit(made.centre))).drop("_x", "_model")


def summary(df: DataFrame, value: str, features: Sequence[str], by: Sequence[str], interact: str | None = None) -> DataFrame:
    """L4: (by..., term, estimate, std_error, t_value, p_value, r2, n, df) of each group's model.

    Terms are in plain units; a text feature's reference is its first level.  A term that
    is a sum of terms before it, or a level that the group lacks, has no row; without
    residual degrees of freedom there are no standard errors."""
    made = design(df, value, features, interact)
    terms, raw = made.terms, made.to_raw()
    centre = made.centre

    @F.arrow_udf("array<struct<term:string,estimate:double,std_error:double,t_value:double,p_value:double,r2:double,n:bigint,df:bigint>>")
    def table(column: pa.Array) -> pa.Array:
        out = []
        for flat in column:
            gram = _square(flat.values.to_numpy())
            beta, inverse, sse, kept = sweep(gram)
            n, left = round(gram[0, 0]), round(gram[0, 0]) - int(kept.sum())
            sst = gram[-1, -1] - gram[0, -1] ** 2 / gram[0, 0]
            estimate = raw @ beta
            estimate[0] += centre
            spread = np.sqrt(np.maximum(np.diag(raw @ inverse @ raw.T), 0) * sse / left) if left > 0 else None
            rows = []
            for k in np.flatnonzero(kept):
                row = {"term": terms[k], "estimate": float(estimate[k]), "n": n, "df": left,
                       "r2": float(1 - sse / sst) if sst > 0 else None, "std_error": None, "t_value": None, "p_value": None}
                if spread is not None and spread[k] > 0:
                    t = float(estimate[k] / spread[k])
                    row |= {"std_error": float(spread[k]), "t_value": t, "p_value": t_tail(t, left)}
                rows.append(row)
            out.append(rows)
        kind = pa.struct([("term", pa.string()), ("estimate", pa.float64()), ("std_error", pa.float64()), ("t_value", pa.float64()),
                          ("p_value", pa.float64()), ("r2", pa.float64()), ("n", pa.int64()), ("df", pa.int64())])
        return pa.array(out, pa.list_(kind))

    return grams(df, made, value, by).select(*by, F.inline(table("gram")))


def holdout(df: DataFrame, made: Design, value: str, by: Sequence[str], split: str = "split",
            train: str = "training", test: str = "test") -> DataFrame:
    """(by..., n_test, sse_test) of each group's model, fitted on its training rows and
    held against its test rows; both come from one aggregation by group and part, and no
    row is predicted.  Null where the training rows lack a level of the test rows."""
    sums = grams(df, made, value, [*by, split])
    both = (sums.where(F.col(split).isin(train, test)).groupBy(*by)
            .agg(F.max(F.when(F.col(split) == train, F.col("gram"))).alias("_train"),
                 F.max(F.when(F.col(split) == test, F.col("gram"))).alias("_test")))
    is_level = made.is_level

    @F.arrow_udf("struct<n_test:bigint,sse_test:double>")
    def error(train_sums: pa.Array, test_sums: pa.Array) -> pa.Array:
        out = []
        for one, two in zip(train_sums, test_sums):
            a, b = _square(one.values.to_numpy()), _square(two.values.to_numpy())
            beta = np.append(sweep(a)[0], -1.0)   # the response counts as -1 times itself
            unseen = (is_level & (np.diag(a)[:-1] == 0) & (np.diag(b)[:-1] != 0)).any()
            out.append({"n_test": round(b[0, 0]), "sse_test": None if unseen else float(beta @ b @ beta)})
        return pa.array(out, pa.struct([("n_test", pa.int64()), ("sse_test", pa.float64())]))

    both = both.where(F.col("_train").isNotNull() & F.col("_test").isNotNull())
    return both.withColumn("_e", error("_train", "_test")).select(*by, "_e.*")
