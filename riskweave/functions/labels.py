"""Text labels for report tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def count_text(n: Column) -> Column:
    """Integer with a thousands separator: 12345 -> "12,345"."""
    return F.format_number(n.cast("long"), 0)


def fixed_text(x: Column, decimals: int) -> Column:
    """Round half away from zero, then print exactly ``decimals`` places (with separators)."""
    return F.format_number(F.round(x, decimals), decimals)


def short_text(x: Column, decimals: int = 2) -> Column:
    """R-style ``format(round(x, d), big.mark=",")``: trailing zeros dropped."""
    s = fixed_text(x, decimals)
    s = F.regexp_replace(s, r"(\.[0-9]*[1-9])0+$", "$1")
    return F.regexp_replace(s, r"\.0+$", "")


def ci_text(x: Column) -> Column:
    """``format(round(x, 3), nsmall = 2)`` per value: three places, at least two."""
    s = F.format_string("%.3f", F.round(x, 3).cast("double"))
    return F.regexp_replace(s, r"(\.[0-9]{2})0$", "$1")


def n_pct(n: Column, pct: Column) -> Column:
    """C26: "n (p)" with n comma-separated and p to two places."""
    return F.concat(count_text(n), F.lit(" ("), fixed_text(pct, 2), F.lit(")"))


def mean_sd(mean: Column, sd: Column) -> Column:
    """C26: "mean (sd)" with two-place rounding and R-style trimming."""
    return F.concat(short_text(mean), F.lit(" ("), short_text(sd), F.lit(")"))


def est_ci(est: Column, lo: Column, hi: Column) -> Column:
    """V7: "est (lo to hi)"."""
    return F.concat(ci_text(est), F.lit(" ("), ci_text(lo), F.lit(" to "), ci_text(hi), F.lit(")"))
