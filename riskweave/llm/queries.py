"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, covertree, decontaminate, jaccard, mixing, pages, phrases, pieces, quality, secrets, tokens, topk
from .common import table
from .oracle import ORACLE  # noqa: F401


def op1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.train(spark))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_join(table(spark, sf_dir, "documents")).select("doc_id", "n_links", "class_id", "kept")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_texts(table(spark, sf_dir, "documents"), ids=False)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat.digests(chat.format_chats(turns))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"))


def op7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"), pages.train(spark))


def op8_covertree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = decontaminate.n_hit()
    items = F.array_sort(F.transform("hits.items", lambda i: i.cast("string")))
    return decontaminate.find_hits(docs, table(spark, sf_dir, "benchmark")).select(
        "doc_id", "hits.n_words", hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op1_tokens": op1_tokens, "op2_secrets": op2_secrets, "op5_chat": op5_chat, "op6_topk": op6_topk, "op7_pages": op7_pages, "op8_covertree": op8_covertree, "op9_quality": op9_quality, "op3_jaccard": op3_jaccard, "op4_mixing": op4_mixing, "op10_sentencepiece": op10_sentencepiece, "op11_phrases": op11_phrases, "op12_decontamination": op12_decontamination, "op13_codes": op13_codes}
