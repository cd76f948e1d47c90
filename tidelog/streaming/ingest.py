"""Ordered ingest of a change log as a stream.

A log is ordered by file and position. State is kept for each file: where the log is
appended to, where it is published to, and the transaction that is open. What
arrives out of order waits in the state until the events before it are there; an event that repeats one is dropped, a
stream that skips bytes stays at its gap. "Published" is a position and not an event time, so
no watermark is involved.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.transactions import step

EVENT_SCHEMA = "event_id long, file_no long, pos long, end_pos long, opens boolean, service boolean, txn_length long"
OUTPUT_SCHEMA = "file_no long, event_id long, pos long, end_pos long, outcome string, published_pos long"
#: appended to, published to, end of the open transaction or -1, and events that wait, as parallel arrays.
STATE_SCHEMA = "appended long, published long, open_end long, ids array<long>, poss array<long>, ends array<long>, opens array<boolean>, services array<boolean>, lengths array<long>"
FIRST = 4


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A1: a stream of the Parquet files that appear in a folder, in batches."""
    return spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _ingest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    appended, published, open_end, *waiting = state.get if state.exists else (FIRST, FIRST, -1, [], [], [], [], [], [])
    events: dict[int, tuple[Any, ...]] = {e[1]: e for e in zip(*waiting, strict=True)}
    for frame in frames:
        for e in frame[["event_id", "pos", "end_pos", "opens", "service", "txn_length"]].itertuples(index=False):
            if e.pos >= appended:
                events.setdefault(int(e.pos), (int(e.event_id), int(e.pos), int(e.end_pos), bool(e.opens), bool(e.service), int(e.txn_length)))
    rows = []
    while appended in events:
        event_id, pos, end_pos, opens, service, length = events.pop(appended)
        outcome, then = step(None if open_end < 0 else open_end, pos, end_pos, opens, service, length)
        open_end, appended = -1 if then is None else then, end_pos
        published = end_pos if outcome in ("GroupEnd", "Standalone") else published
        rows.append((key[0], event_id, pos, end_pos, outcome, published))
    left = [list(x) for x in zip(*sorted(events.values(), key=lambda e: e[1]), strict=True)] or [[] for _ in range(6)]
    state.update((appended, published, open_end, *left))
    yield pd.DataFrame(rows, columns=["file_no", "event_id", "pos", "end_pos", "outcome", "published_pos"])


def ordered_events(events: DataFrame) -> DataFrame:
    """Each event once, in order, with its outcome and the position published with it."""
    return events.groupBy("file_no").applyInPandasWithState(_ingest, OUTPUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def append_to_table(stream: DataFrame, path: str, checkpoint: str):
    """Appends each batch to a folder a batch, so that a batch that runs again replaces itself; starts and returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def waiting(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The gaps that a stream of ordered_events stays at, from its checkpoint: (file_no, appended, first_waiting, waiting).

    A file without events that wait has no row.
    """
    state = spark.read.format("statestore").load(checkpoint).select("key.file_no", "value.groupState.*")
    return state.where(F.size("poss") > 0).select("file_no", "appended", F.array_min("poss").alias("first_waiting"), F.size("poss").cast("long").alias("waiting"))
