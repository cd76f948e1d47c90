"""What may be removed: age, space with hysteresis, admission, the cache's window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def purge(catalog: DataFrame, cutoff: int, high: int, low: int, available: int, min_free: int) -> DataFrame:
    """Catalog with before, removable and removed; removal stops at the first file that must stay.

    A file expires when its successor was created before the cutoff (0 is unknown and never
    expires). Space is short above `high` bytes or below `min_free` available ones;
    removal then goes on until `low` bytes are left and `min_free` are available. The newest file,
    and files in use, not on disk or pinned, stay.
    """
    order = Window.orderBy("file_no")
    everything = Window.partitionBy()
    sized = catalog.withColumns(
        {
            "before": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long"),
            "_total": F.sum("size").over(everything),
            "_next": F.lead("created_at").over(order),
        }
    )
    active = (F.col("_total") > high) | (F.lit(available) < min_free)
    expired = (F.col("_next") != 0) & (F.col("_next") < cutoff)
    short = active & ((F.col("_total") - F.col("before") > low) | (F.lit(available) + F.col("before") < min_free))
    ok = F.col("_next").isNotNull() & ~F.col("in_use") & F.col("on_disk") & (F.col("pins") == 0) & (expired | short)
    marked = sized.withColumn("removable", F.coalesce(ok, F.lit(False)))
    return marked.withColumn("removed", F.min(F.col("removable").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_total", "_next")


def refused_creations(catalog: DataFrame, most: int, reserve: int) -> DataFrame:
    """Files whose earlier ones already fill the space less the reserve."""
    before = F.coalesce(F.sum("size").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return catalog.withColumn("before", before).where(F.col("before") >= max(most - reserve, 0))


def cache_origin(events: DataFrame, window_seconds: int) -> DataFrame:
    """Origin of each event for a reader: cache if it is at most `window_seconds` older than the newest of its file, else disk."""
    newest = F.max("tsec").over(Window.partitionBy("file_no"))
    return events.withColumn("origin", F.when(F.col("tsec") >= newest - window_seconds, "cache").otherwise("disk"))


def cache_counters(origins: DataFrame) -> DataFrame:
    """bytes from either side, and how often a reader crosses from disk to cache, by file."""
    crossed = (F.col("origin") == "cache") & (F.lag("origin").over(Window.partitionBy("file_no").orderBy("pos")) == "disk")
    side = lambda o: F.sum(F.when(F.col("origin") == o, F.col("len")).otherwise(0)).cast("long").alias(f"from_{o}")
    return origins.withColumn("_crossed", crossed).groupBy("file_no").agg(side("cache"), side("disk"), F.count_if("_crossed").alias("crossings"))


def eviction_order(segments: DataFrame) -> DataFrame:
    """H7: unpinned, written segments, the oldest first, in each file."""
    return segments.where(~F.col("pinned") & F.col("written")).withColumn("turn", F.row_number().over(Window.partitionBy("file_no").orderBy("appended_at", "segment")).cast("long"))
