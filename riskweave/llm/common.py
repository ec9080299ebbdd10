"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than blank, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"
WORD_BREAKS = " \t\n\x0b\x0c\r"


#: Bytes of a batch of rows that goes to a Python worker; Spark's own bound of 64 MB is
#: held several times over, in the worker and outside the executor's heap.
BATCH_BYTES = "8m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Send whole texts to Python workers in small batches, unless the session has a
    setting of its own."""
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(frame: DataFrame, name: str) -> str:
    """A column name that the frame doesn't have yet."""
    while name in frame.columns:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def walk_tree(tree) -> list[tuple[int, float, int, int, float]]:
    """A fitted Spark ML classification tree as rows
    (feature, threshold, left, right, share of class 1); feature is -1 at a leaf.
    Row 0 is the root, a value <= threshold goes left."""
    rows: list = []

    def add(node) -> int:
        k = len(rows)
        rows.append(None)
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            total = sum(stats)
            rows[k] = (-1, 0.0, 0, 0, float(stats[1] / total) if total else 0.0)
        else:
            split = node.split()
            left, right = add(node.leftChild()), add(node.rightChild())
            rows[k] = (int(split.featureIndex()), float(split.threshold()), left, right, 0.0)
        return k

    add(tree._java_obj.rootNode())
    return rows


def tree_share(rows, x) -> float:
    """Share of class 1 in the leaf that the feature list ``x`` falls into."""
    k = 0
    while rows[k][0] >= 0:
        k = rows[k][2] if x[rows[k][0]] <= rows[k][1] else rows[k][3]
    return rows[k][4]
