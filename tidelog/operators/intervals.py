"""Sets of transaction numbers as half-open intervals [start, end), one row each, keyed by any columns.

Merging joins overlapping and adjacent intervals; [1, 3) and [3, 5) are [1, 5).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parse import set_text


def merge_intervals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of the intervals of each key, sorted disjoint intervals (F1).

    A new run starts where an interval begins after everything before it has ended.
    """
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    marked = df.withColumn("_open", F.max("end").over(before)).withColumn("_new", (F.col("_open").isNull() | (F.col("start") > F.col("_open"))).cast("int"))
    runs = marked.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def union_sets(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All transactions of either set."""
    columns = [*keys, "start", "end"]
    return merge_intervals(a.select(*columns).unionByName(b.select(*columns)), keys)


def numbers_to_intervals(df: DataFrame, keys: Sequence[str], number: str = "gno") -> DataFrame:
    """The intervals of single numbers: a run is where number minus rank stays the same. Repeated numbers count once."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    runs = df.select(*keys, number).distinct().withColumn("_run", F.col(number) - rank)
    return runs.groupBy(*keys, "_run").agg(F.min(number).alias("start"), (F.max(number) + 1).alias("end")).drop("_run")


def set_texts(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """C17: (keys, text) of merged intervals (keys, uuid as text, tag, start, end): sources by uuid and tag, a comma and a line
    break between uuids, an interval as a or a-b. A set is a row's text and so has to fit in one."""
    own = intervals.groupBy(*keys, "uuid", "tag").agg(set_text(F.collect_list(F.struct("start", "end"))).alias("own"))
    joined = lambda xs, f, by: F.array_join(F.transform(F.array_sort(xs), f), by)
    tags = joined(F.collect_list(F.struct("tag", "own")), lambda x: F.concat(F.when(x["tag"] > "", F.concat(F.lit(":"), x["tag"])).otherwise(F.lit("")), F.lit(":"), x["own"]), "")
    sources = own.groupBy(*keys, "uuid").agg(F.concat("uuid", tags).alias("one"))
    return sources.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("one")), ",\n").alias("text"))


def covered(df: DataFrame, held: DataFrame, keys: Sequence[str], how: str, number: str = "gno") -> DataFrame:
    """Rows of df whose number lies in the merged set held (left_semi), or does not (left_anti).

    The set is matched on the keys with the range as a condition of the same join, so
    that Spark hashes the keys; it decides by size whether to broadcast.
    """
    h = held.select(*(F.col(k).alias(f"_h_{k}") for k in keys), F.col("start").alias("_h_start"), F.col("end").alias("_h_end"))
    same = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    inside = (F.col(number) >= F.col("_h_start")) & (F.col(number) < F.col("_h_end"))
    condition = inside
    for s in same:
        condition = s & condition
    return df.join(h, condition, how)


def uncovered_intervals(df: DataFrame, held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Intervals of df that no single interval of the merged set held contains."""
    h = held.select(*(F.col(k).alias(f"_h_{k}") for k in keys), F.col("start").alias("_h_start"), F.col("end").alias("_h_end"))
    condition = (F.col("start") >= F.col("_h_start")) & (F.col("end") <= F.col("_h_end"))
    for k in keys:
        condition = (F.col(k) == F.col(f"_h_{k}")) & condition
    return df.join(h, condition, "left_anti")


def is_subset(df: DataFrame, held: DataFrame, keys: Sequence[str]) -> bool:
    """An empty set is a subset of any."""
    return uncovered_intervals(df, held, keys).isEmpty()
