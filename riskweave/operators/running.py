"""Running sums within groups, without a group in one task.

Rows carry the number of the range they lie in (``rank.ranges``, or high bits of a whole
number); ranges follow the order.  Sums run inside each (group, range), and offsets come
from the totals of the ranges before, a table of one row for each group and range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import null_safe_join


def running_sums(df: DataFrame, by: Sequence[str], order: str | Column, sums: Mapping[str, str | Column], *,
                 span: str = "_range", reverse: bool = False, inclusive: bool = True,
                 totals: Mapping[str, str] | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums`` (new name: what is summed): the sum over
    the rows of the group up to the row (``reverse``: from the row on), the row itself
    counted if ``inclusive``.  Rows of one group must differ in ``order``.  ``totals``
    (new name: one of the sums) adds the sum over the whole group."""
    by = list(by)
    order = F.col(order) if isinstance(order, str) else order
    turn = (lambda c: c.desc()) if reverse else (lambda c: c.asc())
    here = Window.partitionBy(*by, span).orderBy(turn(order)).rowsBetween(Window.unboundedPreceding, 0)
    value = {n: F.col(c) if isinstance(c, str) else c for n, c in sums.items()}
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = whole.orderBy(turn(F.col(span))).rowsBetween(Window.unboundedPreceding, -1)
    ranges = df.groupBy(*by, span).agg(*[F.sum(v).alias(f"_of_{n}") for n, v in value.items()])
    ranges = ranges.select(*by, span, *[F.coalesce(F.sum(f"_of_{n}").over(before), F.lit(0)).alias(f"_to_{n}") for n in value],
                           *[F.sum(f"_of_{n}").over(whole).alias(t) for t, n in (totals or {}).items()])
    within = df.select("*", *[(F.sum(v).over(here) - (F.lit(0) if inclusive else v)).alias(n) for n, v in value.items()])
    out = null_safe_join(within, ranges, [*by, span])
    return out.withColumns({n: F.col(n) + F.col(f"_to_{n}") for n in value}).drop(*[f"_to_{n}" for n in value])
