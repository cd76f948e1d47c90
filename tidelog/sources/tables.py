"""The canonical tables of a change log, derived from the table events.

No given table holds a real change log, so one is derived: a file a day, an event's
length from its texts, a transaction id per user. The roles given to event types are
stand-ins. DERIVED holds the same definitions as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import kept

#: Bytes before the first event of a file, and of an event's header.
MAGIC_BYTES, HEADER_BYTES = 4, 19
#: Event numbers that one task of a running sum takes of a file or a source.
PART_EVENTS = 100_000
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running(events: DataFrame, key: str, order: str, value, name: str) -> DataFrame:
    """events with `name`: the sum of value over the rows of the same key before this one by `order`, a number from 0.

    A key's rows are summed in parts of PART_EVENTS numbers; the parts' sums, one row each, give each part its
    start. So no task sorts a whole key, and the rows are dealt once.
    """
    parted = events.withColumns({"_part": F.floor(F.col(order) / PART_EVENTS), "_value": value})
    sums = parted.groupBy(key, "_part").agg(F.sum("_value").alias("_sum"))
    upto = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, "_part", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("_start") + F.coalesce(F.sum("_value").over(inside), F.lit(0))
    return parted.join(starts, [key, "_part"]).withColumn(name, total.cast("long")).drop("_part", "_value", "_start")


def plain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events without files, positions and numbers, for queries that return none of these: no running sums. A source's numbers are 1 to its count."""
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("source"), "event_type", "props", "value", F.to_date("ts").alias("day"), F.expr(f"timestampdiff(SECOND, {EPOCH}, ts)").alias("tsec"))


def change_events(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """One row an event: file and position, source and transaction number, length, seconds since 1970.

    Days are numbered in a table of their own, one row a day, so that no window runs over
    all events; positions are running sums in a file, numbers running counts of a source. keep: the rows are
    kept in the shared folder, for queries that read them more than once.
    """
    events = plain_events(spark, sf_dir)
    days = events.select("day").distinct().withColumn("file_no", F.row_number().over(Window.orderBy("day")).cast("long"))
    sized = events.join(F.broadcast(days), "day").withColumn("len", (F.lit(HEADER_BYTES) + F.length("event_type") + F.length("props")).cast("long"))
    placed = running(running(sized, "file_no", "event_id", F.col("len"), "pos"), "source", "event_id", F.lit(1), "gno")
    out = placed.select(
        "event_id",
        "source",
        (F.col("gno") + 1).alias("gno"),
        "event_type",
        "day",
        "file_no",
        file_name(F.col("file_no")).alias("file"),
        "len",
        (F.col("pos") + MAGIC_BYTES).alias("pos"),
        "tsec",
        "value",
        "props",
    ).withColumn("end_pos", F.col("pos") + F.col("len"))
    return kept(out) if keep else out


def file_name(number, base: str = "log"):
    text = number.cast("string")
    return F.concat(F.lit(f"{base}."), F.lpad(text, F.greatest(F.length(text), F.lit(6)), F.lit("0")))


def file_catalog(events: DataFrame) -> DataFrame:
    """One row a file: size, created_at, last_at, events; the newest is in use."""
    files = events.groupBy("file_no", "file").agg((F.sum("len") + MAGIC_BYTES).alias("size"), F.min("tsec").alias("created_at"), F.max("tsec").alias("last_at"), F.count(F.lit(1)).alias("events"))
    return files.join(F.broadcast(files.agg(F.max("file_no").alias("newest"))), how="cross").withColumn("in_use", F.col("file_no") == F.col("newest")).withColumn("on_disk", F.lit(True)).drop("newest")


def previous_sets(events: DataFrame) -> DataFrame:
    """(file_no, source, start, end): transactions of each source before a file, half-open. A source's numbers have no gaps here."""
    last = events.groupBy("source", "file_no").agg(F.max("gno").alias("last"))
    # what a file ends with holds for the files behind it, up to the next one that has the source; file numbers have no gaps
    newest = events.agg(F.max("file_no").alias("newest"))
    until = F.coalesce(F.lead("file_no").over(Window.partitionBy("source").orderBy("file_no")), "newest")
    held = last.join(F.broadcast(newest), how="cross").withColumn("until", until).where("until > file_no")
    return held.select(F.explode(F.sequence(F.col("file_no") + 1, "until")).alias("file_no"), "source", F.lit(1).cast("long").alias("start"), (F.col("last") + 1).alias("end"))


def held_set(events: DataFrame) -> DataFrame:
    """(source, start, end): what a subscriber has, [1, 20 + source % 7) of each source."""
    return events.select("source").distinct().select("source", F.lit(1).cast("long").alias("start"), (F.lit(20) + F.col("source") % 7).cast("long").alias("end"))


def replicas(events: DataFrame) -> DataFrame:
    """One row a subscriber, of each user: where it is, when, whether it dumps and idles. Every fifth time is unknown (0)."""
    last = events.groupBy("source").agg(F.max_by(F.struct("file_no", "file", "end_pos", "tsec"), "event_id").alias("at"))
    return last.select(
        F.format_string("10.%d.%d.%d", (F.col("source") / 65536).cast("int"), ((F.col("source") / 256) % 256).cast("int"), (F.col("source") % 256).cast("int")).alias("address"),
        F.concat(F.lit("user"), "source").alias("user"),
        "at.file_no",
        "at.file",
        F.col("at.end_pos").alias("pos"),
        F.when(F.col("source") % 5 == 0, 0).otherwise(F.col("at.tsec")).cast("long").alias("tsec"),
        (F.col("source") % 3 == 0).alias("idle"),
        (F.col("source") % 4 != 1).alias("dumping"),
        "source",
    )


#: The same tables for the SQL that checks the queries.
DERIVED = r"""
change_events AS (
  SELECT event_id, user_id AS source, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS gno, event_type, day, file_no,
    'log.' || lpad(CAST(file_no AS VARCHAR), CAST(greatest(length(CAST(file_no AS VARCHAR)), 6) AS INTEGER), '0') AS file, len,
    CAST(4 + coalesce(sum(len) OVER (PARTITION BY file_no ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos,
    tsec, value, props,
    CAST(4 + sum(len) OVER (PARTITION BY file_no ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_pos
  FROM (SELECT *, CAST(ts AS DATE) AS day, dense_rank() OVER (ORDER BY CAST(ts AS DATE)) AS file_no,
      CAST(19 + length(event_type) + length(props) AS BIGINT) AS len, CAST(floor(epoch(ts)) AS BIGINT) AS tsec FROM events)
), file_catalog AS (
  SELECT file_no, file, CAST(sum(len) + 4 AS BIGINT) AS size, min(tsec) AS created_at, max(tsec) AS last_at, count(*) AS events,
    file_no = (SELECT max(file_no) FROM change_events) AS in_use, true AS on_disk FROM change_events GROUP BY file_no, file
), previous_sets AS (
  SELECT f.file_no, e.source, CAST(1 AS BIGINT) AS start, max(gno) + 1 AS "end" FROM (SELECT DISTINCT file_no FROM change_events) f
  JOIN change_events e ON e.file_no < f.file_no GROUP BY f.file_no, e.source
), held AS (SELECT DISTINCT user_id AS source, CAST(1 AS BIGINT) AS start, CAST(20 + user_id % 7 AS BIGINT) AS "end" FROM events
), replicas AS (
  SELECT '10.' || source // 65536 || '.' || (source // 256) % 256 || '.' || source % 256 AS address, 'user' || source AS "user",
    a.file_no, a.file, a.end_pos AS pos, CAST(CASE WHEN source % 5 = 0 THEN 0 ELSE a.tsec END AS BIGINT) AS tsec, source % 3 = 0 AS idle, source % 4 <> 1 AS dumping, source
  FROM (SELECT source, arg_max({'file_no': file_no, 'file': file, 'end_pos': end_pos, 'tsec': tsec}, event_id) AS a FROM change_events GROUP BY source)
)"""


def with_derived(sql: str) -> str:
    """A query over the derived tables, as one statement. sql may start with further common tables and a comma."""
    return f"WITH {DERIVED}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
