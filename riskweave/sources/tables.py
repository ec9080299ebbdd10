"""Scans, sinks and frame-level utilities."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_path


def read_table(spark: SparkSession, base: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """Columnar scan of one parquet table; selecting columns prunes the scan."""
    df = spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
             header: bool = True) -> DataFrame:
    """CSV with header and delimiter, always with an explicit schema."""
    return (spark.read.option("header", str(header).lower()).option("sep", sep)
            .option("mode", "FAILFAST").schema(schema).csv(path))


def read_csv_quarantine(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",",
                        header: bool = True, line: str = "bad_line") -> tuple[DataFrame, DataFrame]:
    """S3: (good rows, broken lines) of a CSV.  A line with a value that its column's type
    can't hold, or with too few or too many fields, goes to the second frame as it is, in
    column ``line``; the file is read and written once."""
    whole = T.StructType([*schema.fields, T.StructField(line, T.StringType())])
    rows = (spark.read.option("header", str(header).lower()).option("sep", sep).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", line).schema(whole).csv(path))
    rows = materialize(rows)
    return rows.where(F.col(line).isNull()).drop(line), rows.where(F.col(line).isNotNull()).select(line)


def write_csv(df: DataFrame, path: str, sep: str = ",", row_number_col: str | None = None,
              order_by: list[str] | None = None) -> str:
    """CSV sink.  ``row_number_col`` adds a row index (every row is kept).

    Files are written in parallel by every task; nothing goes through the driver.
    """
    out = df
    if row_number_col:
        from .. operators.rank import global_row_number
        out = global_row_number(df, order_by or df.columns[:1], row_number_col)
    out.write.mode("overwrite").option("header", "true").option("sep", sep).csv(path)
    return path


def save_table(df: DataFrame, name: str, path: str | None = None,
               partition_by: list[str] | None = None) -> DataFrame:
    """Overwrite a table in one call (no drop/create gap) and return a scan of it.

    The table data lives under ``path`` (default: the shared checkpoint folder),
    so a rerun after a lost executor simply rewrites it.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, f"table-{name}")
    writer = df.write.mode("overwrite").format("parquet").option("path", target)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.saveAsTable(name)
    return spark.table(name)


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """A table dealt into ``buckets`` files' groups by ``key`` and sorted inside them.

    Tables of one key type and number of buckets are joined and grouped by that key
    without a shuffle, as often as they are read; the shuffle is paid once, here (one
    file a bucket, by the hash that the buckets use)."""
    spark = df.sparkSession
    target = path or scratch_path(spark, f"bucketed-{name}")
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", target)
     .bucketBy(buckets, key).sortBy(key).saveAsTable(name))
    return spark.table(name)


def publish(df: DataFrame, name: str, path: str, keep: int = 2) -> DataFrame:
    """Replace a table without a gap.  ``df`` is written to a new version folder
    under ``path``; then the view ``name`` is switched to it in one catalog operation, and
    all but the newest ``keep`` versions are deleted.  A reader sees the old or the new
    version; one that began on the old can finish while that is kept."""
    if keep < 1:
        raise ValueError("at least the new version is kept")
    spark = df.sparkSession
    versions = _versions(spark, path)
    new = f"{path.rstrip('/')}/version={(versions[-1][0] if versions else 0) + 1:06d}"
    df.write.parquet(new)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM parquet.`{new}`")
    whole = [folder for _, folder, written in versions if written]
    kept = whole[len(whole) - keep + 1:] if keep > 1 else []
    for _, old, _ in versions:  # also what a failed write left
        if old not in kept:
            fs, at = _folder(spark, old)
            fs.delete(at, True)
    return spark.table(name)


def _folder(spark: SparkSession, path: str):
    """(file system, path) of a folder in Hadoop's terms."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str, bool]]:
    """(number, folder, whether it was written to the end) of the versions under a path,
    oldest first."""
    fs, at = _folder(spark, path)
    if not fs.exists(at):
        return []
    found = [str(s.getPath().toString()) for s in fs.listStatus(at)]
    ended = lambda f: fs.exists(_folder(spark, f + "/_SUCCESS")[1])
    return sorted((int(f.rsplit("version=", 1)[1]), f, ended(f)) for f in found if re.search(r"/version=\d{6,}$", f))


def use_database(spark: SparkSession, name: str) -> str:
    """Make ``name`` the current database and return the one before."""
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(name)
    return before


def snapshot(df: DataFrame, name: str) -> DataFrame:
    """Persist an intermediate result as parquet and read it back."""
    spark = df.sparkSession
    target = scratch_path(spark, f"snapshot-{name}")
    df.write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def select_by_pattern(df: DataFrame, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """Columns whose name matches a regex (plus ``keep`` columns first)."""
    rx = re.compile(pattern)
    keep = list(keep or [])
    cols = keep + [c for c in df.columns if rx.search(c) and c not in keep]
    return df.select(*cols)


def columns_except(df: DataFrame, *patterns: str, kind: str | None = None) -> list[str]:
    """Names of the columns that no pattern matches, of one type (as in ``dtypes``) if
    ``kind`` is given."""
    rx = [re.compile(p) for p in patterns]
    return [c for c, t in df.dtypes if (kind is None or t == kind) and not any(r.search(c) for r in rx)]


def with_headings(df: DataFrame, headings: dict[str, str]) -> DataFrame:
    """P10: columns renamed for print, in place; a heading may hold any characters, but two
    columns can't share one."""
    names = [headings.get(c, c) for c in df.columns]
    if missing := set(headings) - set(df.columns):
        raise ValueError(f"no columns {sorted(missing)}")
    if len(set(names)) < len(names):
        raise ValueError(f"headings repeat: {names}")
    return df.toDF(*names)


def shape(df: DataFrame) -> DataFrame:
    """One row with the row and column counts (a distributed count)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_cols", F.lit(len(df.columns)).cast("int"))


def preview(df: DataFrame, key: list[str] | str, n: int = 10) -> DataFrame:
    """First ``n`` rows by a key (top-k; an unordered head is nondeterministic)."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.orderBy(*keys).limit(n)
