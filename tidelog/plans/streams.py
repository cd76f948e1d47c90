"""Queries that run a stream over the given tables to its end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import tables as t
from ..sources.shared import shared_folder
from ..streaming import ingest
from .catalog import query
from .health import ROLED, _roled


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(
    f"""+ {ROLED} SELECT file_no, count(*) AS events, max(end_pos) AS appended FROM roled GROUP BY file_no"""
)
def j3_stream_ingest(spark, sf_dir):
    """The events, written in files out of order and some twice, are ingested in order and once."""
    folder = _folder(spark)
    events = _roled(spark, sf_dir).select("event_id", "file_no", "pos", "end_pos", "opens", "service", "txn_length")
    events.repartition(4, F.pmod(F.xxhash64("event_id"), F.lit(4))).write.parquet(f"{folder}/in")
    events.where("event_id % 10 = 0").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = ingest.ordered_events(ingest.read_events(spark, f"{folder}/in", 2))
    ingest.append_to_table(stream, f"{folder}/out", f"{folder}/state").awaitTermination()
    done = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return done.groupBy("file_no").agg(F.count(F.lit(1)).alias("events"), F.max("end_pos").alias("appended"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 0 SECOND GROUP BY 1, 2", derived=False)
def j2_stream_hourly_counts(spark, sf_dir):
    """Events by hour over a stream: hours that the watermark has closed."""
    folder = _folder(spark)
    schema = t.table(spark, sf_dir, "events").schema
    t.table(spark, sf_dir, "events").repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "0 seconds")
    counts = stream.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    hours = counts.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
    query = hours.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2", derived=False)
def j2_stream_hourly_totals(spark, sf_dir):
    """Events of every hour over a stream, those that are still open too: each batch writes the counts it changed to a folder of its own, the last one holds."""
    folder = _folder(spark)
    events = t.table(spark, sf_dir, "events").select("ts", "event_type")
    events.repartitionByRange(4, "ts").write.parquet(f"{folder}/in")
    counts = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    counts.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/state").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.option("basePath", f"{folder}/out").parquet(f"{folder}/out")
    return done.groupBy(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type").agg(F.max_by("n", "batch").alias("n"))
