"""Imputation.

Stage 1 fills a missing value from the mean of its (label, sex) group when the
label is known; stage 2 predicts the rest with an OLS model per sex.  Group means are a
(labels x sexes) table in an ordinary join; the models of all groups come from one
aggregation (``normal``), and so does their error on rows that are held out.  Predicting
on the rows that need it replaces the study's split/predict/union dance.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.recode import poly_terms, sentinel_to_null
from ..session import materialize
from . import normal
from .common import attach_row, per_group
from .sampling import hash_split


def group_means(df: DataFrame, value: str, keys: Sequence[str], out: str = "prediction_mm") -> DataFrame:
    """A5: mean of ``value`` per group over rows where value and keys are known."""
    cond = F.col(value).isNotNull()
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.where(cond).groupBy(*keys).agg(F.avg(value).alias(out))


def impute_group_mean(df: DataFrame, value: str, label: str, keys: Sequence[str],
                      means: DataFrame | None = None, flag: str | None = None) -> DataFrame:
    """Fill a missing value with its group mean, only when the label is known."""
    m = means if means is not None else group_means(df, value, keys)
    x = df.join(per_group(m), list(keys), "left")
    fill = F.col(value).isNull() & F.col(label).isNotNull()
    if flag:
        x = x.withColumn(flag, F.when(F.col(value).isNotNull(), 0)
                         .when(fill & F.col("prediction_mm").isNotNull(), 1))
    return x.withColumn(value, F.when(fill, F.col("prediction_mm")).otherwise(F.col(value))) \
            .drop("prediction_mm")


def ols_coefficients(df: DataFrame, value: str, covariate: str, group: str) -> DataFrame:
    """L4 (one covariate): intercept, slope, n and R^2 per group, in one aggregation.
    A group without spread in the covariate has a null intercept and slope."""
    y, x = F.col(value).cast("double"), F.col(covariate).cast("double")
    return (df.where(F.col(group).isNotNull() & y.isNotNull() & x.isNotNull()).groupBy(group)
            .agg(F.regr_intercept(y, x).alias("intercept"), F.regr_slope(y, x).alias("slope"),
                 F.regr_count(y, x).cast("long").alias("n"), F.regr_r2(y, x).alias("r2")))


def impute_by_model(df: DataFrame, value: str, group: str, features: Sequence[str], interact: str | None = None,
                    flag: str | None = None) -> DataFrame:
    """L3/L6 stage 2: per-group OLS fitted on observed rows, used where value is null.

    A value stays null (and its flag null) where there is nothing to predict it from:
    a null group, a group without an observed value, a null feature, or a category
    that no observed row of the group has.  Two aggregations fit all groups; the rows
    are then read once."""
    made = normal.design(df, value, features, interact)
    fit = normal.fits(normal.grams(df.where(F.col(group).isNotNull()), made, value, [group]), made)
    pred = f"_{value}_pred"
    out = normal.predicted(df, fit, made, [group], pred)
    filled = F.col(value).isNull() & F.col(pred).isNotNull()
    if flag:
        before = F.col(flag) if flag in df.columns else F.when(F.col(value).isNotNull(), F.lit(0))
        out = out.withColumn(flag, F.when(filled, F.lit(2)).otherwise(before))
    return out.withColumn(value, F.coalesce(F.col(value), F.col(pred))).drop(pred)


def model_frame(df: DataFrame, age: str = "age", fill_zero: Sequence[str] = ()) -> DataFrame:
    """Polynomial age terms and zero-filled record columns for the OLS design."""
    out = df.withColumns(poly_terms(age, 3))
    return out.fillna(0, subset=list(fill_zero)) if fill_zero else out


def impute_two_stage(df: DataFrame, value: str = "bmi", label: str = "bmi_cat",
                     group: str = "sex", features: Sequence[str] = (), interact: str | None = None,
                     flag: str = "imputed") -> DataFrame:
    """Sentinel 0 -> null, group-mean fill where the label is known, then OLS per
    group for the rest; ``imputed`` is 0 observed, 1 group mean, 2 model."""
    # the group means and all passes of the model stage read this frame: write it once
    x = materialize(df.withColumn(value, sentinel_to_null(F.col(value), 0)))
    x = impute_group_mean(x, value, label, [label, group], flag=flag)
    return impute_by_model(x, value, group, list(features), interact, flag=flag)


def imputer_mse(df: DataFrame, id_col: str, value: str, label: str, group: str,
                features: Sequence[str], interact: str | None = None, frac: float = 0.7,
                salt: str = "split") -> DataFrame:
    """Hold-out MSE of the group-mean imputer vs a per-group OLS imputer on
    ``features``, and the number of test rows.

    The models' errors come from sums of products alone (``normal.holdout``): mse_lm is
    over the test rows whose features are known, and null if the training rows of a
    group lack a level of its test rows.  A test row without a mean leaves mse_mm."""
    x = materialize(hash_split(df.where(F.col(value).isNotNull() & F.col(label).isNotNull()), id_col, frac, salt))
    made = normal.design(x.where(F.col("split") == "training"), value, features, interact)
    lm = normal.holdout(x.where(F.col(group).isNotNull()), made, value, [group]).agg(
        F.when(F.count("sse_test") == F.count(F.lit(1)), F.try_divide(F.sum("sse_test"), F.sum("n_test"))).alias("mse_lm"))
    train, test = x.where(F.col("split") == "training"), x.where(F.col("split") == "test")
    t = test.join(per_group(group_means(train, value, [label, group])), [label, group], "left")
    mm = t.agg(F.avg(F.pow(F.col(value) - F.col("prediction_mm"), 2)).alias("mse_mm"), F.count(F.lit(1)).alias("n_test"))
    return attach_row(lm, mm)


def impute_audit(df: DataFrame, value: str, group: str, flag: str) -> DataFrame:
    """Observed vs imputed distribution per group."""
    return (df.groupBy(group, flag)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"),
                 F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max")))
