"""Lag, distance and the status document. Null is unknown and never 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = {"connected": 0, "catching_up": 1, "streaming": 2}
RELAY_STATES = {"starting": 0, "serving": 1, "reconnecting": 2}
BAD_LAG, WARN_LAG, BAD_FILL, WARN_FILL = 60, 5, 95, 80


def behind_seconds(clock: Column, tsec: Column, idle: Column) -> Column:
    """0 if idle, unknown without a clock or a time, else clock less time, not below 0."""
    return F.when(idle, F.lit(0).cast("long")).when(clock.isNull() | (tsec == 0), F.lit(None).cast("long")).otherwise(F.greatest(clock - tsec, F.lit(0).cast("long")))


def replica_status(replicas: DataFrame, offsets: DataFrame, clock: int, published: DataFrame) -> DataFrame:
    """each subscriber's state, bytes and seconds behind. offsets: (file, before); published: (file, pos), one row.

    A subscriber that does not dump is connected, and nothing is known of its lag or distance. One that dumps
    is streaming where it idles, else catching up; its distance runs to the published position and is unknown if a file is, or if it is ahead.
    """
    end = published.join(offsets, "file").select((F.col("before") + F.col("pos")).alias("_end"))
    known = replicas.join(offsets.select("file", "before"), "file", "left").join(F.broadcast(end), how="left")
    distance = F.col("_end") - F.col("before") - F.col("pos")
    lag = behind_seconds(F.lit(clock).cast("long"), F.col("tsec"), F.col("idle"))
    out = known.withColumn("behind_bytes", F.when(F.col("dumping") & (distance >= 0), distance).cast("long")).withColumn("behind_seconds", F.when(F.col("dumping"), lag))
    state = F.when(~F.col("dumping"), "connected").when(F.col("idle"), "streaming").otherwise("catching_up")
    return out.withColumn("state", state).withColumn("state_code", state_code(F.col("state"))).drop("before", "_end")


def state_code(state: Column, states: dict[str, int] = STATES) -> Column:
    """The number of a subscriber's state, or of the relay's with RELAY_STATES."""
    out = F.lit(None).cast("int")
    for name, code in states.items():
        out = F.when(state == name, code).otherwise(out)
    return out


def rollup(status: DataFrame) -> DataFrame:
    """subscribers by state, and the worst known lag."""
    return status.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.max("behind_seconds").alias("worst"))


def status_document(status: DataFrame) -> DataFrame:
    """One JSON document for each subscriber, keys in a fixed order, unknown values as null."""
    fields = ["address", "user", "state", "state_code", "file", "pos", "behind_bytes", "behind_seconds"]
    return status.select("source", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def extract_items(documents: DataFrame) -> DataFrame:
    """The monitored items of a status document."""
    path = lambda p: F.get_json_object("document", p)
    return documents.select("source", path("$.address").alias("address"), path("$.user").alias("user"), path("$.behind_seconds").cast("long").alias("behind_seconds"), path("$.state_code").cast("int").alias("state_code"))


def lag_class(seconds: Column) -> Column:
    """Unknown has no class."""
    return F.when(seconds >= BAD_LAG, "bad").when(seconds >= WARN_LAG, "warn").when(seconds.isNotNull(), "ok")


def fill_class(used: Column, most: Column) -> Column:
    percent = 100 * used / most
    return F.when(percent >= BAD_FILL, "bad").when(percent >= WARN_FILL, "warn").when(percent.isNotNull(), "ok")


def duration_text(seconds: Column) -> Column:
    """[d ]hh:mm:ss."""
    part = lambda x: F.lpad(x.cast("long").cast("string"), 2, "0")
    clock = F.concat_ws(":", part(F.floor(seconds / 3600) % 24), part(F.floor(seconds / 60) % 60), part(seconds % 60))
    return F.when(seconds >= 86400, F.concat(F.floor(seconds / 86400).cast("string"), F.lit("d "), clock)).otherwise(clock)


def bytes_text(count: Column) -> Column:
    """A size in IEC units with one decimal, rounded half up."""
    out = F.concat(count.cast("string"), F.lit(" B"))
    for power, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        tenths = F.floor((count * 10 + 2 ** (10 * power - 1)) / 2 ** (10 * power)).cast("long")
        out = F.when(count >= 2 ** (10 * power), F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def alert_windows(samples: DataFrame, key: str, seconds: int, samples_back: int) -> DataFrame:
    """Least, most and last value of the past `seconds`, the value some samples ago, and silence before a sample."""
    by = Window.partitionBy(key)
    recent, order = by.orderBy("tsec").rangeBetween(-seconds, 0), by.orderBy("tsec", "event_id")
    return samples.select(
        key,
        "event_id",
        "tsec",
        F.min("value").over(recent).alias("least"),
        F.max("value").over(recent).alias("most"),
        F.count(F.lit(1)).over(recent).alias("n"),
        F.lag("value", samples_back).over(order).alias("earlier"),
        ((F.col("tsec") - F.lag("tsec").over(order)) > seconds).alias("silent"),
    )


def percentiles(df: DataFrame, key: str, value: str, shares: tuple[float, ...] = (0.5, 0.99)) -> DataFrame:
    """values at rank floor(share * (n - 1)) of each key, from 0, and the largest. Ranked by a window, never gathered in an array."""
    ranked = df.select(key, value).withColumns({"_rank": F.row_number().over(Window.partitionBy(key).orderBy(value)), "_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    at = [F.max(F.when(F.col("_rank") == F.floor(F.lit(s) * (F.col("_n") - 1)) + 1, F.col(value))).alias(f"p{round(100 * s)}") for s in shares]
    return ranked.groupBy(key).agg(*at, F.max(value).alias("largest"))


def stream_counters(events: DataFrame, key: str, heartbeat: list[str], artificial: list[str]) -> DataFrame:
    """Events, heartbeats, artificial events, bytes, the largest event."""
    return events.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_type").isin(heartbeat)).alias("heartbeats"),
        F.count_if(F.col("event_type").isin(artificial)).alias("artificial"),
        F.sum("len").cast("long").alias("bytes"),
        F.max("len").alias("largest"),
    )


def stream_summary(events: DataFrame) -> DataFrame:
    """The first and the last position, and the counters between them."""
    return events.agg(
        F.min_by("file", "event_id").alias("first_file"),
        F.min_by("pos", "event_id").alias("first_pos"),
        F.max_by("file", "event_id").alias("last_file"),
        F.max_by("end_pos", "event_id").alias("last_pos"),
        F.count(F.lit(1)).alias("events"),
        F.sum("len").cast("long").alias("bytes"),
    )


def monotone_positions(rows: DataFrame, key: str) -> DataFrame:
    """A heartbeat may only move a position forward: the furthest so far."""
    return rows.withColumn("reached", F.max("pos").over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))


def latest_sessions(sessions: DataFrame, key: str) -> DataFrame:
    """Of the sessions of a subscriber the newest holds its claim."""
    return sessions.withColumn("holds", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("since"), F.desc("session"))) == 1)
