"""The queries opN_<name>: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, licenses, line_dedup, mix, ngram_lm, quality, secrets, shard, simhash
from .common import documents, word_count


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    mixed = mix.mix_sources(sized, mix.code_point_weights(docs), budget=1.5, max_epochs=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return line_dedup.drop_boilerplate(pages, ratio=0.3, least_pages=3, keep=["page_id"])


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
    )
    return shard.shard_documents(rows, shards=24).withColumn("grown_shard", F.lit(None).cast("int")).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(documents(spark, sf_dir))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(documents(spark, sf_dir).select("doc_id", "text"))
    return scored.drop("probability")


def op7_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.held_out_scores(documents(spark, sf_dir).select("doc_id", "text"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(documents(spark, sf_dir))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir), width=3, radius=3)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return decontaminate.digest(decontaminate.find_windows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_line_dedup, op3_shard, op4_chat_format, op5_license_scan, op6_quality_rules, op7_ngram_lm, op8_secret_scan, op9_simhash, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mix.oracle_sql(), "op2_line_dedup": line_dedup.oracle_sql(), "op4_chat_format": chat.oracle_sql(), "op5_license_scan": licenses.oracle_sql()}
