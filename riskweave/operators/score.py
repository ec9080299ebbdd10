"""Risk scoring from a coefficient table (V1), baseline-profile relative risk."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixture model: synthetic coefficients with no clinical meaning (FIXTURES.md).
FIXTURE_COEFFICIENTS = (
    {"term": "age", "center": 60.0, "beta": 0.01},
    {"term": "n_rec", "center": 4.0, "beta": 0.25},
    {"term": "flag_a", "center": 0.0, "beta": 0.3},
)
FIXTURE_BASELINE_SURVIVAL = 0.98


def _rows(coefs) -> list[dict]:
    if isinstance(coefs, DataFrame):
        # One term of the score expression per row: a table that is too long for an
        # expression is too long for a model.
        return [r.asDict() for r in coefs.collect()]
    return [dict(r) for r in coefs]


def _term(row: dict, values: Mapping[str, Column] | None) -> Column:
    col = (values or {}).get(row["term"], F.col(row["term"]))
    beta = F.lit(float(row["beta"]))
    level = row.get("level")
    if level is not None:
        return beta * F.coalesce((col == F.lit(level)).cast("double"), F.lit(0.0))
    center = float(row.get("center") or 0.0)
    return beta * (F.coalesce(col.cast("double"), F.lit(0.0)) - F.lit(center))


def linear_predictor(coefs, sex_col: str = "sex",
                     values: Mapping[str, Column] | None = None) -> Column:
    """Sum of beta * term.  Rows of the table with a ``sex`` value apply to that sex
    only; a null/absent ``sex`` applies to everyone.  A missing term value counts
    as 0 (absence of a record = absence of the condition)."""
    rows = _rows(coefs)
    common = [r for r in rows if r.get("sex") is None]
    by_sex: dict = {}
    for r in rows:
        if r.get("sex") is not None:
            by_sex.setdefault(r["sex"], []).append(r)
    total = F.lit(0.0)
    for r in common:
        total = total + _term(r, values)
    if by_sex:
        specific = None
        for s, rs in by_sex.items():
            part = F.lit(0.0)
            for r in rs:
                part = part + _term(r, values)
            specific = (F.when(F.col(sex_col) == F.lit(s), part) if specific is None
                        else specific.when(F.col(sex_col) == F.lit(s), part))
        total = total + specific
    return total


def _baseline(s0, sex_col: str) -> Column:
    if isinstance(s0, Mapping):
        out = None
        for s, v in s0.items():
            out = (F.when(F.col(sex_col) == F.lit(s), F.lit(float(v))) if out is None
                   else out.when(F.col(sex_col) == F.lit(s), F.lit(float(v))))
        return out
    return F.lit(float(s0))


def score_from_lp(lp: Column, s0: Column, digits: int | None = None) -> Column:
    """Absolute risk in percent: 100 * (1 - S0 ^ exp(lp)).

    ``digits`` rounds it, off by default.  Two engines may differ in the last bits of
    exp and pow, which decides whether mathematically equal scores tie; a comparison
    between engines therefore rounds on both sides."""
    score = 100.0 * (1.0 - F.pow(s0, F.exp(lp)))
    return score if digits is None else F.round(score, digits)


def risk_score(df: DataFrame, coefs=FIXTURE_COEFFICIENTS,
               baseline_survival=FIXTURE_BASELINE_SURVIVAL, sex_col: str = "sex",
               lp_col: str = "a", score_col: str = "score", digits: int | None = None) -> DataFrame:
    """V1: add the linear predictor and the percent score (a pure projection)."""
    lp = linear_predictor(coefs, sex_col)
    return (df.withColumn(lp_col, lp)
              .withColumn(score_col, score_from_lp(F.col(lp_col), _baseline(baseline_survival, sex_col), digits)))


def relative_risk(df: DataFrame, profile: Mapping[str, object], coefs=FIXTURE_COEFFICIENTS,
                  baseline_survival=FIXTURE_BASELINE_SURVIVAL, sex_col: str = "sex",
                  score_col: str = "score", base_col: str = "baseline_score",
                  rr_col: str = "relative_risk", digits: int | None = None) -> DataFrame:
    """V2: score of the same person with the baseline profile, and the ratio.

    The study scores a counterfactual copy of the table and joins it back on the
    person id; both scores are functions of the same row, so here they are
    computed in one projection — no second scan, no join, no shuffle.  The
    stratum columns therefore always come from the real (not the profiled) row.
    """
    values = {c: F.lit(v) for c, v in profile.items()}
    s0 = _baseline(baseline_survival, sex_col)
    out = df
    if score_col not in df.columns:
        out = risk_score(out, coefs, baseline_survival, sex_col, "a", score_col, digits)
    base_lp = linear_predictor(coefs, sex_col, values)
    return (out.withColumn(base_col, score_from_lp(base_lp, s0, digits))
               .withColumn(rr_col, F.try_divide(F.col(score_col), F.col(base_col))))
