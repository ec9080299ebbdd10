"""Cohort definition: eligibility, period windows, follow-up and re-censoring,
projections and profile overrides (F1-F5, C14-C17, P1-P7)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType


def _d(x) -> Column:
    return F.lit(x.isoformat() if isinstance(x, (dt.date, dt.datetime)) else x).cast("date")


def eligible(df: DataFrame, start, age_col: str = "age", age_range=(19, 100),
             death_col: str = "death_date", region_col: str = "region",
             exclude_regions: Iterable[str] = (), resident: Column | None = None) -> DataFrame:
    """alive at start or died on/after it (null-retaining), age within range,
    region known and not excluded (null-dropping), optional residency predicate."""
    cond = ((F.col(death_col).isNull() | (F.col(death_col) >= _d(start)))
            & F.col(age_col).between(*age_range)
            & F.col(region_col).isNotNull())
    excl = list(exclude_regions)
    if excl:
        cond = cond & ~F.col(region_col).isin(*excl)
    if resident is not None:
        cond = cond & resident
    return df.where(cond)


def in_period(df: DataFrame, date_col: str, start, end) -> DataFrame:
    """closed date window; a null date is dropped."""
    return df.where(F.col(date_col).between(_d(start), _d(end)))


def at_risk(df: DataFrame, date_col: str, start) -> DataFrame:
    """not dead before the period start (null-retaining)."""
    return df.where(F.col(date_col).isNull() | (F.col(date_col) >= _d(start)))


def subset_eq(df: DataFrame, **equals) -> DataFrame:
    """conjunction of equality predicates."""
    cond = None
    for k, v in equals.items():
        c = F.col(k) == F.lit(v)
        cond = c if cond is None else cond & c
    return df if cond is None else df.where(cond)


def split_null(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(rows where col is null, rows where it is not)."""
    return df.where(F.col(col).isNull()), df.where(F.col(col).isNotNull())


ALIVE = "Alive"


def truncate_outcome(death: Column, end) -> Column:
    """C15, two states: a death after the study end counts as alive at the end (1/0)."""
    return F.when(death.isNotNull() & (death <= _d(end)), 1).otherwise(0)


def truncate_cause(cause: Column, death: Column, end, alive: str = ALIVE) -> Column:
    """C15, with causes: whoever dies after the study end is alive at the end; so is a
    row without a cause.  A cause without a date is kept."""
    return F.when(cause.isNull() | ((cause != alive) & (death > _d(end))), F.lit(alive)).otherwise(cause)


def followup_days(death: Column, died: Column, start, end) -> Column:
    """Days to death, or to the administrative end when alive."""
    return F.when(died == 1, F.datediff(death, _d(start))).otherwise(F.datediff(_d(end), _d(start)))


def add_outcome(df: DataFrame, start, end, death_col: str = "death_date",
                event_col: str = "death_covid", time_col: str = "t", cause_col: str | None = None,
                event_cause: str = "COVID", outcome_col: str = "outcome",
                other_col: str = "death_other", alive: str = ALIVE) -> DataFrame:
    """P5 (sequential): the follow-up time uses the truncated outcome.

    With ``cause_col`` there are competing deaths: ``outcome_col`` is the truncated
    cause, ``event_col`` and ``other_col`` flag a death of the study's cause and any
    other, and a death of any cause ends the follow-up on its date."""
    if cause_col is None:
        return (df.withColumn(event_col, truncate_outcome(F.col(death_col), end))
                  .withColumn(time_col, followup_days(F.col(death_col), F.col(event_col), start, end)))
    out = df.withColumn(outcome_col, truncate_cause(F.col(cause_col), F.col(death_col), end, alive))
    outcome = F.col(outcome_col)
    died = (outcome != alive).cast("int")
    return (out.withColumn(event_col, (outcome == event_cause).cast("int"))
            .withColumn(other_col, ((outcome != alive) & (outcome != event_cause)).cast("int"))
            .withColumn(time_col, followup_days(F.col(death_col), died, start, end)))


def recensor(df: DataFrame, periods: Sequence[tuple], death_col: str = "death_date",
             event_col: str = "death_covid", time_col: str = "t",
             period_col: str = "period") -> DataFrame:
    """C17 + F3: one row per person and period with the period's (t, event).

    Periods are given as ``(id, start, end)``.  Rows are generated with an inline
    array (no join), a person already dead before a period's start is not at
    risk in it, the event uses ``death <= end`` with three-valued logic and the
    time uses ``death < end`` (both as in the study).
    """
    arr = F.array(*[F.struct(F.lit(p).cast("int").alias(period_col),
                             _d(s).alias("_ps"), _d(e).alias("_pe")) for p, s, e in periods])
    x = df.select("*", F.inline(arr))
    death = F.col(death_col)
    x = x.where(death.isNull() | (death >= F.col("_ps")))
    hit = (death <= F.col("_pe")) & (F.col(event_col) == 1)
    return (x.withColumn(event_col, F.when(hit, 1).when(~hit, 0))
             .withColumn(time_col, F.when(death.isNotNull() & (death < F.col("_pe")),
                                          F.datediff(death, F.col("_ps")))
                         .otherwise(F.datediff(F.col("_pe"), F.col("_ps"))))
             .drop("_ps", "_pe"))


def project_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """``{new: old}`` projection with renames (keeps mapping order)."""
    return df.select(*[F.col(old).alias(new) for new, old in mapping.items()])


def override(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Set columns to constants (types follow the existing columns)."""
    dtypes = dict(df.dtypes)
    cols = {}
    for c, v in values.items():
        lit = F.lit(v)
        cols[c] = lit.cast(dtypes[c]) if c in dtypes else lit
    return df.withColumns(cols)


def reference_profile(df: DataFrame, keep: Sequence[str], reference: Mapping[str, object] | None = None) -> dict:
    """The baseline profile of a frame, by exclusion: every numeric or boolean column
    outside ``keep`` at its lowest level (0, false) unless ``reference`` names a value.

    Text, date and nested columns stay as they are unless ``reference`` names them.  A name
    that the frame doesn't have, or that is both kept and set, raises."""
    values = dict(reference or {})
    absent = sorted({*keep, *values} - set(df.columns))
    if absent:
        raise ValueError(f"no such columns: {', '.join(absent)}")
    both = sorted(set(keep) & set(values))
    if both:
        raise ValueError(f"kept and set: {', '.join(both)}")
    out = {}
    for f in df.schema.fields:
        if f.name in values:
            out[f.name] = values[f.name]
        elif f.name not in keep and isinstance(f.dataType, (NumericType, BooleanType)):
            out[f.name] = 0  # false, where override casts it to boolean
    return out


def profile_from_table(df: DataFrame, profile: DataFrame, name: str = "column", value: str = "value") -> dict:
    """A baseline profile kept as a table of (column, value as text), one row for each
    column of ``df`` to set.  A null value sets null.

    The table is read to the driver, as a profile has at most one row a column: more rows,
    repeated or unknown columns and values that the column's type can't hold raise."""
    rows = profile.select(F.col(name).alias("c"), F.col(value).cast("string").alias("v")).limit(len(df.columns) + 1).collect()
    names = [r["c"] for r in rows]
    wrong = sorted({str(c) for c in names if c not in df.columns or names.count(c) > 1})
    if wrong:
        raise ValueError(f"not one row for one column: {', '.join(wrong)}")
    types = dict(df.dtypes)
    held = [F.lit(r["v"]).try_cast(types[r["c"]]).isNotNull() for r in rows if r["v"] is not None]
    given = [r for r in rows if r["v"] is not None]
    if given:
        fits = df.sparkSession.range(1).select(F.array(*held).alias("fits")).first()["fits"]
        bad = [f"{r['c']}={r['v']}" for r, ok in zip(given, fits) if not ok]
        if bad:
            raise ValueError(f"values of another type: {', '.join(bad)}")
    return {r["c"]: r["v"] for r in rows}


def drop_existing(df: DataFrame, *cols: str) -> DataFrame:
    """Drop columns; absent names are ignored (the study drops some twice)."""
    return df.drop(*cols)
