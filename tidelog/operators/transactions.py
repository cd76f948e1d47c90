"""Transactions in an ordered stream: grouping, what is complete, what is published, recovery."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .checks import is_valid_gno
from .intervals import merge_intervals, numbers_to_intervals, union_sets


def in_file():
    return Window.partitionBy("file_no").orderBy("pos")


def group_by_length(events: DataFrame) -> DataFrame:
    """G6 for well-formed streams: txn_pos, where the event's transaction began, and outcome.

    Events have opens (boolean: begins a transaction) and txn_length (bytes from its
    start). An event that ends where the transaction does is its GroupEnd.
    """
    sofar = in_file().rowsBetween(Window.unboundedPreceding, 0)
    opened = events.withColumns({"_pos": F.last(F.when(F.col("opens"), F.col("pos")), ignorenulls=True).over(sofar), "_end": F.last(F.when(F.col("opens"), F.col("pos") + F.col("txn_length")), ignorenulls=True).over(sofar)})
    inside = F.col("_pos").isNotNull() & (F.col("pos") < F.col("_end"))
    outcome = F.when(F.col("opens"), "GroupStart").when(~F.coalesce(inside, F.lit(False)), "Standalone").when(F.col("end_pos") == F.col("_end"), "GroupEnd").when(F.col("end_pos") < F.col("_end"), "InGroup").otherwise("Malformed")
    return opened.withColumn("txn_pos", F.when(inside, F.col("_pos"))).withColumn("outcome", outcome).drop("_pos", "_end")


def step(open_end: int | None, pos: int, end_pos: int, opens: bool, service: bool, length: int) -> tuple[str, int | None]:
    """The outcome of one event, and the end of the transaction that is open after it.

    While one is open, a further start or a service event is malformed, as is
    crossing its end; neither closes it. A start never ends its own group.
    """
    if open_end is None:
        return ("GroupStart", pos + length) if opens else ("Standalone", None)
    if opens or service or end_pos > open_end:
        return "Malformed", open_end
    return ("GroupEnd", None) if end_pos == open_end else ("InGroup", open_end)


def group_strictly(events: DataFrame) -> DataFrame:
    """G6 with malformed events: each outcome depends on all before it in its file, so a file is walked in order.

    Files are sorted in their partitions and streamed through the task in batches; no
    file is held in memory.
    """
    columns = ["event_id", "file_no", "pos", "end_pos", "opens", "service", "txn_length"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file_no, open_end = None, None
        for batch in batches:
            outcomes = []
            for f, pos, end_pos, opens, service, length in zip(*(batch.column(c).to_pylist() for c in columns[1:]), strict=True):
                if f != file_no:
                    file_no, open_end = f, None
                outcome, open_end = step(open_end, pos, end_pos, opens, service, length)
                outcomes.append(outcome)
            yield pa.RecordBatch.from_arrays([batch.column("event_id"), batch.column("file_no"), batch.column("pos"), batch.column("end_pos"), pa.array(outcomes, pa.string())], [*columns[:4], "outcome"])

    return events.select(*columns).repartition("file_no").sortWithinPartitions("file_no", "pos").mapInArrow(walk, "event_id long, file_no long, pos long, end_pos long, outcome string")


def start_faults(starts: DataFrame) -> DataFrame:
    """Starts of transactions (gno, anonymous, txn_length) that are malformed, each with its `fault`; such a start opens none.

    number: anonymous ones have 0, others 1 to 2^63-2; no_length: it is null; zero_length.
    """
    fault = F.when(~F.coalesce(is_valid_gno(F.col("gno"), F.col("anonymous")), F.lit(False)), "number").when(F.col("txn_length").isNull(), "no_length").when(F.col("txn_length") == 0, "zero_length")
    return starts.withColumn("fault", fault).where("fault IS NOT NULL")


def published_positions(outcomes: DataFrame) -> DataFrame:
    """Per file the end of the last event after which no transaction is open."""
    return outcomes.where(F.col("outcome").isin("GroupEnd", "Standalone")).groupBy("file_no").agg(F.max("end_pos").alias("published_pos"))


def recover(events: DataFrame, outcomes: DataFrame, newest: int) -> DataFrame:
    """Per file the last boundary, the bytes behind it and what to do: keep, truncate (the newest), or corrupt (a closed one)."""
    ends = events.groupBy("file_no").agg(F.max("end_pos").alias("size"))
    cut = ends.join(published_positions(outcomes), "file_no", "left").withColumn("boundary", F.coalesce("published_pos", F.lit(4).cast("long")))
    tail = F.col("size") - F.col("boundary")
    action = F.when(tail == 0, "keep").when(F.col("file_no") == newest, "truncate").otherwise("corrupt")
    return cut.select("file_no", "boundary", tail.alias("tail_bytes"), action.alias("action"))


def completed(transactions: DataFrame) -> DataFrame:
    """F8: the set of transactions (source, gno) that are complete; anonymous ones, of number 0, add none."""
    return numbers_to_intervals(transactions.where("gno > 0"), ["source"])


def executed(previous: DataFrame, done: DataFrame, newest: int) -> DataFrame:
    """what precedes the newest file together with what is complete in it."""
    return union_sets(previous.where(F.col("file_no") == newest), done, ["source"])


def purged(previous: DataFrame, oldest: int) -> DataFrame:
    """what precedes the oldest file that is left."""
    return merge_intervals(previous.where(F.col("file_no") == oldest).select("source", "start", "end"), ["source"])
