"""Descriptive tables in one pass.

The study runs one query per variable and binds the results; here the frame is
unpivoted to (variable, value) inside the map stage and counted with a single
partial/final aggregation, so the shuffle carries only distinct (variable,
value) pairs however many variables there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FractionalType

from ..functions import labels


def sum_all(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A1: global sums (partial sums per task, one tiny final merge)."""
    return df.agg(*[F.sum(c).cast("long").alias(c) for c in cols])


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """A4: number of nulls per column, one pass."""
    cols = list(cols or df.columns)
    return df.agg(*[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in cols])


def frequency_table(df: DataFrame, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """N, percentage and "n (p)" label per (variable, value)."""
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("string").alias("value"))
        for v in variables])).alias("kv")).select(*by, "kv.variable", "kv.value")
    counts = long.groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by, "variable")
    pct = F.col("n") * 100.0 / F.sum("n").over(w)
    return (counts.withColumn("pct", pct)
                  .withColumn("count_label", labels.n_pct(F.col("n"), F.col("pct"))))


def numeric_table(df: DataFrame, variables: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample SD per continuous variable, straight to wide columns."""
    long = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(v).alias("variable"), F.col(v).cast("double").alias("x"))
        for v in variables])).alias("kv")).select(*by, "kv.variable", "kv.x")
    return (long.groupBy(*by, "variable")
            .agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"))
            .withColumn("mean_sd", labels.mean_sd(F.col("mean"), F.col("sd"))))


def discover(df: DataFrame, ignore: Sequence[str], continuous: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(categorical, continuous) variables of a frame: all columns but those ignored,
    in their order.  Continuous are columns of fractional types and those named.

    Ignored names that the frame lacks do no harm; continuous ones that it lacks raise."""
    absent = sorted(set(continuous) - set(df.columns))
    if absent:
        raise ValueError(f"no such columns: {', '.join(absent)}")
    found = [f for f in df.schema.fields if f.name not in ignore]
    numeric = [f.name for f in found if f.name in continuous or isinstance(f.dataType, FractionalType)]
    return [f.name for f in found if f.name not in numeric], numeric


def describe_all(df: DataFrame, categorical: Sequence[str], continuous: Sequence[str],
                 populations: Mapping[str, Column] | None = None) -> DataFrame:
    """Frequency rows for categorical and mean/SD rows for continuous
    variables, for every population (a row may belong to several), one frame.

    One scan and one aggregation: every row lists its (variable, value, x), where
    categorical variables have a value and continuous ones an x, and carries one
    0/1 flag per population; counts and moments are conditional on the flag."""
    pops = dict(populations or {"all": F.lit(True)})
    items = [F.struct(F.lit(v).alias("variable"), F.lit(False).alias("numeric"),
                      F.col(v).cast("string").alias("value"), F.lit(None).cast("double").alias("x"))
             for v in categorical]
    items += [F.struct(F.lit(v).alias("variable"), F.lit(True).alias("numeric"),
                       F.lit(None).cast("string").alias("value"), F.col(v).cast("double").alias("x"))
              for v in continuous]
    member = [c.alias(f"_in{k}") for k, c in enumerate(pops.values())]
    long = df.select(*member, F.inline(F.array(*items)))
    aggs = []
    for k in range(len(pops)):
        here = F.col(f"_in{k}")
        aggs += [F.count(F.when(here, 1)).alias(f"_rows{k}"), F.count(F.when(here, F.col("x"))).alias(f"_known{k}"),
                 F.avg(F.when(here, F.col("x"))).alias(f"_mean{k}"),
                 F.stddev_samp(F.when(here, F.col("x"))).alias(f"_sd{k}")]
    wide = long.groupBy("variable", "numeric", "value").agg(*aggs)
    rows = wide.select("variable", "numeric", "value", F.inline(F.array(*[
        F.struct(F.lit(name).alias("population"), F.col(f"_rows{k}").alias("rows"),
                 F.col(f"_known{k}").alias("known"), F.col(f"_mean{k}").alias("mean"), F.col(f"_sd{k}").alias("sd"))
        for k, name in enumerate(pops)]))).where("rows > 0")
    share = F.col("rows") * 100.0 / F.sum("rows").over(Window.partitionBy("population", "variable"))
    rows = rows.withColumn("pct", F.when(~F.col("numeric"), share))
    return rows.select(
        "population", "variable", "value", F.when(F.col("numeric"), F.col("known")).otherwise(F.col("rows")).alias("n"),
        "pct", "mean", "sd",
        F.when(F.col("numeric"), labels.mean_sd(F.col("mean"), F.col("sd")))
        .otherwise(labels.n_pct(F.col("rows"), F.col("pct"))).alias("label"))
