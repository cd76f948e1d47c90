"""The catalogue of log files: order, neighbours, sums of sizes, distances, start files.

A catalogue has one row a file; windows over all its rows are over files, never over events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import uncovered_intervals


def by_number():
    return Window.orderBy("file_no")


def with_offsets(catalog: DataFrame) -> DataFrame:
    """Before, the bytes of all files before a file."""
    upto = by_number().rowsBetween(Window.unboundedPreceding, -1)
    return catalog.withColumn("before", F.coalesce(F.sum("size").over(upto), F.lit(0)).cast("long"))


def with_neighbours(catalog: DataFrame) -> DataFrame:
    """The next file, when it was created, and whether a reader may follow: the file is closed."""
    return catalog.withColumns({"next_file": F.lead("file").over(by_number()), "next_created_at": F.lead("created_at").over(by_number()), "previous_no": F.lag("file_no").over(by_number())}).withColumn(
        "may_follow", F.col("next_file").isNotNull() & ~F.col("in_use")
    )


def totals(catalog: DataFrame) -> DataFrame:
    """Files, bytes, the first and the last file."""
    return catalog.agg(F.count(F.lit(1)).alias("files"), F.sum("size").cast("long").alias("bytes"), F.min_by("file", "file_no").alias("first_file"), F.max_by("file", "file_no").alias("last_file"))


def start_file(catalog: DataFrame, previous: DataFrame, held: DataFrame) -> DataFrame:
    """The newest file whose previous transactions the subscriber all has; files without any qualify."""
    missing = uncovered_intervals(previous, held, ["source"]).select("file_no").distinct()
    return catalog.join(missing, "file_no", "left_anti").orderBy(F.desc("file_no")).limit(1)


def read_boundaries(catalog: DataFrame, published: DataFrame) -> DataFrame:
    """How far a reader may go: the published position in its file, else the file's size."""
    return catalog.join(published, "file_no", "left").withColumn("boundary", F.least("size", F.coalesce("published_pos", "size")))


def read_range(events: DataFrame, file_no: int, start: int, length: int, boundary: Column) -> DataFrame:
    """Events of one file that begin in [start, min(start + length, boundary)); bodies are not read unless selected."""
    return events.where((F.col("file_no") == file_no) & (F.col("pos") >= start) & (F.col("pos") < F.least(F.lit(start + length), boundary)))


def bytes_between(pairs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Bytes from (from_file, from_pos) to (to_file, to_pos); null if a file is unknown or the order is reversed."""
    offsets = with_offsets(catalog).select("file", "before")
    side = lambda name: offsets.select(F.col("file").alias(f"{name}_file"), F.col("before").alias(f"_{name}"))
    joined = pairs.join(side("from"), "from_file", "left").join(side("to"), "to_file", "left")
    distance = F.col("_to") + F.col("to_pos") - F.col("_from") - F.col("from_pos")
    return joined.withColumn("distance", F.when(distance >= 0, distance)).drop("_from", "_to")
