"""What a log refuses to append: arrivals out of place, and events sent again that differ from those it has."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FIRST = 4


def append_faults(arrivals: DataFrame) -> DataFrame:
    """The arrivals that may not follow the one before them, each with its `fault`.

    Arrivals have stream, ord (0, 1, ... in each stream), kind, file_no, pos, end_pos and open_after (whether a
    transaction is open after it). Kinds: announce (the next file's name), description, previous (sets before the file),
    event, and close (the file ends). A file is announced, begins with its description at 4 and its previous sets, and its
    events leave no gap. Files are announced once, in ascending order, and no transaction is open then.

    Each arrival meets the one before by its number, so that no task walks a stream; only announcements, one a
    file, go through a window. A sink stops at a stream's first fault: see appended().
    """
    before = arrivals.select("stream", (F.col("ord") + 1).alias("ord"), F.col("kind").alias("_kind"), F.col("end_pos").alias("_end"), F.col("open_after").alias("_open"))
    earlier = Window.partitionBy("stream").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    highest = arrivals.where("kind = 'announce'").select("stream", "ord", F.max("file_no").over(earlier).alias("_highest"))
    known = arrivals.join(before, ["stream", "ord"], "left").join(highest, ["stream", "ord"], "left")
    kind, last = F.col("kind"), F.col("_kind")
    waits, writing = last.isNull() | (last == "close"), last.isin("previous", "event")
    fault = (
        F.when(waits & (kind != "announce"), "expected_announcement")
        .when((last == "announce") & ((kind != "description") | (F.col("pos") != FIRST)), "expected_description")
        .when((last == "description") & ((kind != "previous") | (F.col("pos") != F.col("_end"))), "expected_previous_sets")
        .when(kind.isin("announce", "close") & F.col("_open"), "interrupts_transaction")
        .when((kind == "announce") & (F.col("file_no") < F.col("_highest")), "lower_number")
        .when((kind == "announce") & (F.col("file_no") == F.col("_highest")), F.when(writing, "still_open").otherwise("exists"))
        .when(writing & kind.isin("description", "previous"), "unexpected_header")
        .when(writing & kind.isin("event", "close") & (F.col("pos") > F.col("_end")), "gap")
        .when(writing & kind.isin("event", "close") & (F.col("pos") < F.col("_end")), "behind")
    )
    return known.withColumn("fault", fault).where("fault IS NOT NULL").drop("_kind", "_end", "_open", "_highest")


def appended(arrivals: DataFrame, faults: DataFrame) -> DataFrame:
    """The arrivals of each stream before its first fault."""
    first = faults.groupBy("stream").agg(F.min("ord").alias("_first"))
    return arrivals.join(first, "stream", "left").where(F.col("_first").isNull() | (F.col("ord") < F.col("_first"))).drop("_first")


def resent_faults(resent: DataFrame, stored: DataFrame, compared: Sequence[str]) -> DataFrame:
    """Events sent again, after a stream was lost, that are not what the log has at their place, each with its `fault`.

    differs: a compared column does; no_event_there: the place is behind the end of what the file holds, but no event
    begins there. What lies at or past that end is new. resent may be a stream, stored is not. Events meet on
    file and position; a null equals a null.
    """
    at = stored.select("file_no", "pos", F.struct(*compared).alias("_had"))
    ends = stored.groupBy("file_no").agg(F.max("end_pos").alias("_size"))
    met = resent.join(at, ["file_no", "pos"], "left").join(ends, "file_no", "left")
    there = F.col("_had").isNotNull()
    fault = F.when(there & ~F.struct(*compared).eqNullSafe(F.col("_had")), "differs").when(~there & (F.col("pos") < F.col("_size")), "no_event_there")
    return met.withColumn("fault", fault).where("fault IS NOT NULL").drop("_had", "_size")
