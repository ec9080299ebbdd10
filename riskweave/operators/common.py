"""Small shared helpers for operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

WHOLE_NUMBERS = ("tinyint", "smallint", "int", "bigint")
FEW_GROUPS = 1_000     # rows of a table of groups that every executor holds whatever the session's limit


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null keys match each other (group keys may be null)."""
    if not keys:
        raise ValueError("null_safe_join needs at least one key")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond: Column = reduce(lambda a, b: a & b,
                          [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    return left.join(r, cond, how).drop(*[f"__r_{k}" for k in keys])


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys; with no keys, attach a single-row frame."""
    if keys:
        return null_safe_join(left, right, keys, how)
    return attach_row(left, right)


def per_group(groups: DataFrame) -> DataFrame:
    """A table of one row per group (means, models), to be joined to the rows of those groups.

    Groups can be few and large, so their rows must not be dealt by group: that puts a
    whole group into one task.  An aggregation's size is only guessed when the join is
    planned, so it is written first.  Up to ``FEW_GROUPS`` rows are then broadcast; above
    that the planner compares the written size with the session's limit."""
    written = materialize(groups)
    few = written.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    return F.broadcast(written) if few else written


def attach_row(left: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row aggregate to every row of ``left``: a cross join
    with exactly one row, which is all that is broadcast."""
    return left.crossJoin(F.broadcast(one_row))
