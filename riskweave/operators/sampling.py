"""Deterministic sampling (M1-M3): hash splits and outcome-dependent subsamples.

``randomSplit``/``sample`` depend on partitioning, so a rerun after a lost
executor could pick different rows.  A salted md5 of the id is stable, is the
same in every engine, and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hash_unit(id_col: str, salt: str) -> Column:
    """First 8 hex digits of md5(id || salt) as a string (compare with ``threshold_hex``)."""
    return F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(salt))), 1, 8)


def threshold_hex(frac: float) -> str:
    return format(min(int(frac * 2 ** 32), 2 ** 32 - 1), "08x") if frac < 1 else "g"


def hash_split(df: DataFrame, id_col: str, frac: float = 0.7, salt: str = "split",
               out: str = "split", names=("training", "test")) -> DataFrame:
    """M1: label each row training/test by a salted hash of its id."""
    return df.withColumn(out, F.when(hash_unit(id_col, salt) < F.lit(threshold_hex(frac)), names[0])
                         .otherwise(names[1]))


def case_sample(df: DataFrame, id_col: str, event: str, frac: float, salt: str = "123",
                weight: str = "weight") -> DataFrame:
    """M2: keep every case, keep a ``frac`` share of non-cases (by hash), and weight
    kept non-cases by ``1/frac`` so weighted metrics estimate the full cohort."""
    keep = (F.col(event) == 1) | (hash_unit(id_col, salt) < F.lit(threshold_hex(frac)))
    return (df.where(keep)
              .withColumn(weight, F.when(F.col(event) == 1, F.lit(1.0)).otherwise(F.lit(1.0 / frac))))
