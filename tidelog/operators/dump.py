"""What a subscriber is sent: where it starts, which transactions are skipped, generated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import covered

IN_USE, ARTIFICIAL = 0x1, 0x20
ROTATE, FORMAT_DESCRIPTION, HEARTBEAT = 4, 15, 27


def needed_events(events: DataFrame, held: DataFrame) -> DataFrame:
    """Events of transactions that the subscriber does not have."""
    return covered(events, held, ["source"], "left_anti")


def skip_flags(events: DataFrame, held: DataFrame, deciding: list[str]) -> DataFrame:
    """Skipped (boolean). Events of a deciding type set it by whether the subscriber has their number; the rest inherit it in their file."""
    h = held.select(F.col("source").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    known = events.join(h, (F.col("source") == F.col("_s")) & (F.col("gno") >= F.col("_a")) & (F.col("gno") < F.col("_b")), "left")
    order = Window.partitionBy("file_no").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    decided = F.when(F.col("event_type").isin(deciding), F.col("_s").isNotNull())
    return known.withColumn("skipped", F.coalesce(F.last(decided, ignorenulls=True).over(order), F.lit(False))).drop("_s", "_a", "_b")


def dump_totals(flagged: DataFrame) -> DataFrame:
    """events and bytes sent and skipped, by file."""
    return flagged.groupBy("file_no").agg(
        F.count_if(~F.col("skipped")).alias("sent"),
        F.count_if("skipped").alias("skipped"),
        F.sum(F.when(F.col("skipped"), 0).otherwise(F.col("len"))).cast("long").alias("sent_bytes"),
    )


def dump(flagged: DataFrame, catalog: DataFrame, first_file_no) -> DataFrame:
    """The rows sent: a generated rotate row before each file, the events that are not skipped, a heartbeat in place of each skipped run.

    kind is rotate, event or heartbeat; pos32 is what fits the header's 32 bits.
    """
    events = flagged.where(F.col("file_no") >= first_file_no)
    order = Window.partitionBy("file_no").orderBy("pos")
    last_of_run = F.col("skipped") & ~F.coalesce(F.lead("skipped").over(order), F.lit(False))
    sent = events.withColumn("_last", last_of_run).where(~F.col("skipped") | F.col("_last"))
    rows = sent.select("file_no", F.when(F.col("skipped"), F.col("end_pos")).otherwise(F.col("pos")).alias("pos"), F.when(F.col("skipped"), F.lit("heartbeat")).otherwise("event").alias("kind"), F.when(~F.col("skipped"), F.col("event_id")).alias("event_id"))
    rotate = catalog.where(F.col("file_no") >= first_file_no).select("file_no", F.lit(4).cast("long").alias("pos"), F.lit("rotate").alias("kind"), F.lit(None).cast("long").alias("event_id"))
    return rotate.unionByName(rows).withColumn("pos32", F.col("pos").bitwiseAND(F.lit(0xFFFFFFFF)))


def idle_heartbeats(events: DataFrame, period: int) -> DataFrame:
    """One row for each whole period without an event, in each file: when a heartbeat is due, at which position."""
    order = Window.partitionBy("file_no").orderBy("pos")
    gap = events.withColumn("_next", F.lead("tsec").over(order)).where(F.col("_next") - F.col("tsec") > period)
    due = F.explode(F.sequence(F.col("tsec") + period, F.col("_next") - 1, F.lit(period).cast("long")))
    return gap.select("file_no", F.col("end_pos").alias("pos"), due.alias("due"))


def start_decision(requests: DataFrame, previous: DataFrame, catalog: DataFrame, own_source: int) -> DataFrame:
    """(address, decision, start_no): how a request is answered, and from which file.

    requests: (address, ok_text boolean, source, start, end), a row an interval of a merged set; a request with an
    empty set has a row whose source is null. In this order a request is bad_set if its text does not parse, own_uuid if it names
    the relay's own source, no_history without a file, purged if no file's previous set is contained in its
    own (E2), else ok: it starts from the newest file whose previous set is.

    Intervals that are contained are counted for each request and file and compared with how many a
    file has; previous sets of no request's sources are never paired with it.
    """
    asked = requests.groupBy("address").agg(F.bool_and("ok_text").alias("ok"), F.coalesce(F.bool_or(F.col("source") == own_source), F.lit(False)).alias("own"))
    held = requests.select("address", F.col("source").alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    contained = previous.join(held, (F.col("source") == F.col("_s")) & (F.col("start") >= F.col("_a")) & (F.col("end") <= F.col("_b")))
    has = contained.groupBy("address", "file_no").agg(F.count(F.lit(1)).alias("_has"))
    needs = catalog.select("file_no").join(previous.groupBy("file_no").agg(F.count(F.lit(1)).alias("_needs")), "file_no", "left")
    enough = has.join(needs, "file_no").where("_has = _needs").groupBy("address").agg(F.max("file_no").alias("_from"))
    # one row: the newest file that needs nothing, and whether there is any file
    free = needs.agg(F.max(F.when(F.col("_needs").isNull(), F.col("file_no"))).alias("_free"), F.count(F.lit(1)).alias("_files"))
    both = asked.join(enough, "address", "left").join(F.broadcast(free), how="cross").withColumn("start_no", F.greatest("_from", "_free"))
    decision = F.when(~F.col("ok"), "bad_set").when(F.col("own"), "own_uuid").when(F.col("_files") == 0, "no_history").when(F.col("start_no").isNull(), "purged").otherwise("ok")
    return both.withColumn("decision", decision).select("address", "decision", F.when(F.col("decision") == "ok", F.col("start_no")).alias("start_no"))


def rewrite_description(rows: DataFrame, zero_created) -> DataFrame:
    """Clears the in-use flag, zeroes created where the subscriber holds part of the file, recomputes the checksum of the row's text."""
    cleared = rows.withColumn("flags", F.col("flags").bitwiseAND(F.lit(~IN_USE))).withColumn("created", F.when(zero_created, 0).otherwise(F.col("created")).cast("long"))
    return cleared.withColumn("checksum", F.crc32(F.concat_ws("|", "flags", "created")))
