"""The corpus pipeline: five operators of tidelog.llm, each over what its predecessor kept.

STAGES lists them; each takes (spark, docs, sf_dir) and returns documents, the last
one with shard and slot. run() writes what a stage returns as Parquet in the
shared folder and reads it as the next stage's documents.

In every stage columns of other names are carried along, repeated rows are rows of their own unless said
otherwise, long texts are read whole, and an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import decontaminate, mix, quality, shard, simhash
from tidelog.llm.common import documents, use_checkpoint_dir, word_count


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are probably bad by the votes of all rules, go. Null and empty texts fail; equal texts share one fate."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike in 0.8 or more of their five-word shingles, the smallest doc_id stays, of repeated rows one.

    Null and empty texts form one group; a null doc_id stays only if its group has no other.
    """
    return simhash.keep_one_of_each(docs, width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item, or a whole shorter item, go. Null texts and texts without words stay; so does all if there is no benchmark."""
    return decontaminate.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh 5, 2, 1 in turn; the mix takes 150 % of the words, no document more than twice.

    A null source is a source of its own, the last one. Documents without words go. Ties in the order of a source are broken by the hash that draws it.
    """
    return mix.mixed_documents(docs, mix.code_point_weights(docs), 1.5, 2, word_count(F.col("text")))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A uniform shuffle into 24 shards whose sizes differ by one at most. Nulls are values like others; ties fall in any order; with fewer rows than shards some stay empty."""
    return shard.shard_documents(docs, shards=24)


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The label model, fingerprints and random draws can't be expressed in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
