"""Recodes, bands, flags and safe casts as built-in Column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the study (code lists and labels that results depend on).
# ethpuk11 code -> 16-level ethnicity.
ETHNICITY_16 = {1: 1, 2: 2, 3: 3, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7, 9: 8, 10: 9, 11: 10, 12: 15,
                13: 11, 14: 13, 15: 12, 16: 14, 17: 16, 18: 16}
# ethpuk11 code -> 9 groups.
ETHNICITY_9 = {1: "White British", 2: "White other", 3: "White other", 4: "White other",
               5: "Mixed", 6: "Mixed", 7: "Mixed", 8: "Mixed", 9: "Indian", 10: "Pakistani",
               11: "Bangladeshi", 12: "Chinese", 13: "Other", 14: "Black African",
               15: "Black Caribbean", 16: "Other", 17: "Other", 18: "Other"}
# Therapy code letters -> ordinal category.
CHEMO_CODES = {"A": 1, "B": 2, "C": 3}
# BMI bands (labels) and 10-year age bands (labels, lower bounds; top band open).
BMI_BANDS = ("18.5 to 25", "< 18.5", "25 to 30", ">= 30", "Missing")
BMI_LABELS = ("IDEAL", "UNDERWEIGHT", "OVERWEIGHT", "OBESE", "UNDER 20 NULLS")
AGE_BANDS = ((19, "19 - 29 years"), (30, "30 - 39 years"), (40, "40 - 49 years"),
             (50, "50 - 59 years"), (60, "60 - 69 years"), (70, "70 - 79 years"),
             (80, "80 - 89 years"), (90, "90+ years"))
# Interval age groups used for stratified metrics: right-open [a,b).
AGE_BREAKS = (19, 30, 40, 50, 60, 70, 80, 90, 101)
# ---------------------------------------------------------------------------


def safe_num(c: Column | str, to: str = "double") -> Column:
    """String code -> number; a non-numeric code becomes null (ANSI-safe)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.try_cast(to)


def ethnicity_16(code: Column) -> Column:
    """16-level ethnicity of a code; null for a code outside the list."""
    return recode_map(code, ETHNICITY_16).cast("int")


def ethnicity_9(code: Column) -> Column:
    """Ethnic group label of a code; null for a code outside the list."""
    return recode_map(code, ETHNICITY_9)


def recode_map(col: Column, mapping: dict, otherwise=None) -> Column:
    """C1/C11 generic: value -> value map (first match wins)."""
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out if otherwise is None else out.otherwise(otherwise)


def chemo_category(code: Column) -> Column:
    """A3 helper: therapy letter -> ordinal (null for any other code)."""
    return recode_map(code, CHEMO_CODES).cast("int")


def collapse(col: Column, src, dst) -> Column:
    """C11: merge one category into another (e.g. diabetes 1 -> 2)."""
    return F.when(col == src, F.lit(dst)).otherwise(col)


def age_band(age: Column) -> Column:
    """10-year half-open bands with an open top band; null below the first."""
    out = None
    bounds = [b for b, _ in AGE_BANDS] + [None]
    for (lo, label), hi in zip(AGE_BANDS, bounds[1:]):
        cond = (age >= lo) if hi is None else ((age >= lo) & (age < hi))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def age_interval(age: Column, breaks: Sequence[int] = AGE_BREAKS) -> Column:
    """Interval label ``[a,b)`` for right-open age groups (null outside)."""
    out = None
    for lo, hi in zip(breaks[:-1], breaks[1:]):
        cond = (age >= lo) & (age < hi)
        label = f"[{lo},{hi})"
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def clean_interval(label: Column) -> Column:
    """Axis text of an interval label, ``[20,30)`` to `` 20-30``."""
    return F.translate(label, "[,()", " -")


def bmi_band(bmi: Column, label: Column) -> Column:
    """C4, reproduced literally: AND binds tighter than OR, so a known label can
    override the numeric value (bmi 35 with label IDEAL -> "18.5 to 25")."""
    ideal, under, over, obese, missing = BMI_BANDS
    return (F.when(((bmi >= 18.5) & (bmi < 25)) | (label == "IDEAL"), ideal)
            .when((bmi < 18.5) | (label == "UNDERWEIGHT"), under)
            .when(((bmi >= 25) & (bmi < 30)) | (label == "OVERWEIGHT"), over)
            .when((bmi >= 30) | (label == "OBESE"), obese)
            .when(bmi.isNull() & (label.isNull() | (label == "UNDER 20 NULLS")), missing))


def flag(cond: Column, three_valued: bool = False) -> Column:
    """0/1 flag.  ``three_valued`` keeps a null condition null (R ``ifelse``)."""
    if three_valued:
        return F.when(cond, 1).when(~cond, 0)
    return F.when(cond, 1).otherwise(0)


def present(col: Column) -> Column:
    """1 when a linked value is present, else 0."""
    return col.isNotNull().cast("int")


def sentinel_to_null(col: Column, sentinel=0) -> Column:
    """A sentinel value means unknown."""
    return F.nullif(col, F.lit(sentinel))


def either_source(primary: Column, secondary: Column) -> Column:
    """Multi-source OR where a positive primary overrides the secondary; 0 if both absent."""
    return F.coalesce(F.when(primary == 1, F.lit(1)).otherwise(secondary), F.lit(0))


def dummies(col: str, levels: Iterable) -> dict[str, Column]:
    """One 0/1 column per level (null input -> 0 for every level)."""
    return {f"{col}_{_slug(lv)}": F.coalesce((F.col(col) == F.lit(lv)).cast("int"), F.lit(0))
            for lv in levels}


def _slug(v) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in str(v)).strip("_").lower()


def poly_terms(col: str, degree: int = 3) -> dict[str, Column]:
    """Polynomial terms ``col2``..``colN`` (exact integer powers as double)."""
    out = {}
    for d in range(2, degree + 1):
        term = F.col(col).cast("double")
        for _ in range(d - 1):
            term = term * F.col(col).cast("double")
        out[f"{col}{d}"] = term
    return out
