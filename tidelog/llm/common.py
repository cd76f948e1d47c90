"""What the operators of this subpackage share.

Working columns start with ``_tl_`` so that they never clash with a column of the
input; a column that an operator adds replaces an input column of the same name.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder in spark.checkpoint.dir; a local session without one gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder; a lost executor loses none."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def global_prefix_sum(df: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over the rows before this one in the order of the whole table.

    The rows are range-sorted; the sums of the partitions, one row each, give each
    partition its start. No task holds more than one range.
    """
    ranged = checkpointed(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn("_tl_range", F.spark_partition_id()))
    ranges = ranged.groupBy("_tl_range").agg(F.sum(value).alias("_tl_sum"))
    before = Window.orderBy("_tl_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_tl_range", F.coalesce(F.sum("_tl_sum").over(before), F.lit(0)).alias("_tl_start"))
    inside = Window.partitionBy("_tl_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the shuffle: its size is bounded by their number.
    return (
        ranged.join(F.broadcast(starts), "_tl_range")
        .withColumn(name, F.col("_tl_start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .drop("_tl_range", "_tl_start")
    )
