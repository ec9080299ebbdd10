"""The corpus pipeline: documents in, encoded documents out.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the
columns of documents; extra columns pass through them, whatever their names.

Null and empty texts are scored like any other and, if they are kept, are no one's
copies, hold no secrets, have no words to mix (so the mix takes none of them) and reach
no encoding.  Of rows with equal id and text one stays.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import jaccard, mixing, pieces, quality, secrets
from riskweave.llm.common import bound_batches, fresh, table
from riskweave.sources.tables import snapshot


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    bound_batches(spark)
    return jaccard.one_of_each(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced; n_chars follows the change in length."""
    bound_batches(spark)
    length = fresh(docs, "__length")
    before = docs.withColumn(length, F.length("text"))
    clean = secrets.redact(before, secrets.train(spark))
    grown = F.coalesce(F.length("text") - F.col(length), F.lit(0))
    return clean.withColumn("n_chars", F.col("n_chars") + grown).drop(length)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it (0 to 3 times)."""
    bound_batches(spark)
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text and digests of the ids and of the text decoded from them."""
    bound_batches(spark)
    return pieces.encode_texts(docs)


STAGES = [("quality", keep_good), ("jaccard", keep_one), ("secrets", redact), ("mixing", mix), ("pieces", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = snapshot(docs, name)
    return docs


#: Stages fit models and hash token ids, which SQL can't express; tests/llm holds run()
#: against plain code on a small folder.
ORACLE_SQL = None
