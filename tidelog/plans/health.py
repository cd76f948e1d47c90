"""Queries over checks, retention, transactions and status, with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import decode, parse
from ..operators import catalog as cat
from ..operators import checks, retention, status, transactions
from ..operators import intervals as iv
from ..sources import tables as t
from .catalog import query

ROLES = "signup opens a transaction of the length of its next two events; error is a service event"


@query("SELECT event_id, (end_pos + CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) & 4294967295 AS next_pos FROM change_events WHERE event_id % 97 = 0 AND event_type <> 'signup'")
def d5_position_breaks(spark, sf_dir):
    stated = t.change_events(spark, sf_dir).withColumn("next_pos", (F.col("end_pos") + F.when(F.col("event_id") % 97 == 0, 1).otherwise(0)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return checks.position_breaks(stated, ["signup"]).select("event_id", "next_pos")


@query("SELECT * FROM (SELECT event_id, pos - lag(end_pos - CASE WHEN event_id % 53 = 7 THEN 3 ELSE 0 END) OVER (PARTITION BY file_no ORDER BY pos) AS gap FROM change_events) WHERE gap > 0")
def d14_gaps(spark, sf_dir):
    """Some events end three bytes early."""
    return checks.gaps(t.change_events(spark, sf_dir).withColumn("end_pos", F.col("end_pos") - F.when(F.col("event_id") % 53 == 7, 3).otherwise(0))).select("event_id", "gap")


@query("SELECT * FROM (SELECT event_id, seq, (lag(seq) OVER (PARTITION BY file_no ORDER BY pos) + 1) % 256 AS expected FROM (SELECT *, (event_id + CASE WHEN event_id % 101 = 3 THEN 1 ELSE 0 END) % 256 AS seq FROM change_events)) WHERE seq <> expected")
def g2_sequence_breaks(spark, sf_dir):
    """Some events carry the number of the next one."""
    packets = t.change_events(spark, sf_dir).withColumn("seq", (F.col("event_id") + F.when(F.col("event_id") % 101 == 3, 1).otherwise(0)) % 256)
    return checks.sequence_breaks(packets).select("event_id", "seq", "expected")


HEARTBEATS = "(SELECT event_id, file_no, event_id AS ord, event_id % 10 = 3 AS heartbeat, pos - CASE WHEN event_id % 30 = 3 THEN 500 ELSE 0 END AS pos FROM change_events)"


def _heartbeats(spark, sf_dir):
    return t.change_events(spark, sf_dir).select("event_id", "file_no", F.col("event_id").alias("ord"), (F.col("event_id") % 10 == 3).alias("heartbeat"), (F.col("pos") - F.when(F.col("event_id") % 30 == 3, 500).otherwise(0)).alias("pos"))


@query(f"SELECT event_id, pos, reached FROM (SELECT *, max(pos) OVER (PARTITION BY file_no ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM {HEARTBEATS}) WHERE heartbeat AND pos < reached")
def d13_heartbeat_regressions(spark, sf_dir):
    return checks.heartbeat_regressions(_heartbeats(spark, sf_dir)).select("event_id", "pos", "reached")


@query(f"SELECT event_id, max(pos) OVER (PARTITION BY file_no ORDER BY ord ROWS UNBOUNDED PRECEDING) AS reached FROM {HEARTBEATS}")
def g9_monotone_positions(spark, sf_dir):
    return status.monotone_positions(_heartbeats(spark, sf_dir), "file_no").select("event_id", "reached")


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN gno = 0 ELSE gno BETWEEN 1 AND 9223372036854775806 END AS valid, CASE WHEN event_type = 'error' THEN 'service' WHEN event_type = 'signup' THEN 'transaction' ELSE 'other' END AS class FROM change_events")
def d6_number_range(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    return events.select("event_id", checks.is_valid_gno(F.col("gno"), F.col("event_type") == "view").alias("valid"), checks.event_class(F.col("event_type"), ["error"], ["signup"]).alias("class"))


@query(
    """+ ends AS (SELECT min(file_no) + 2 AS first_no, max(file_no) - 1 AS last_no FROM file_catalog),
  idx AS (SELECT file AS name, file_no FROM file_catalog, ends WHERE file_no BETWEEN first_no AND last_no AND (file_no % 9 <> 4 OR file_no IN (first_no, last_no))),
  dir AS (SELECT file AS name, file_no FROM file_catalog WHERE file_no % 8 <> 5 UNION ALL SELECT 'old.' || lpad(CAST(file_no AS VARCHAR), 6, '0'), NULL FROM file_catalog WHERE file_no % 10 = 3 UNION ALL SELECT file || '.part', -1 FROM file_catalog WHERE file_no % 10 = 4),
  both_ AS (SELECT coalesce(i.name, d.name) AS name, i.name IS NOT NULL AS indexed, d.name IS NOT NULL AS there, d.file_no FROM idx i FULL JOIN dir d ON i.name = d.name)
  SELECT name, CASE WHEN indexed AND there THEN 'ok' WHEN indexed THEN 'missing' WHEN file_no = -1 THEN 'not_a_name' WHEN file_no IS NULL THEN 'other_base'
    WHEN file_no > last_no AND (SELECT count(*) FROM both_ b, ends e WHERE NOT b.indexed AND b.file_no > e.last_no) > 1 THEN 'several_newer' WHEN file_no > last_no THEN 'newer' WHEN file_no < first_no THEN 'older' ELSE 'inside' END AS state FROM both_, ends"""
)
def e3_reconcile(spark, sf_dir):
    """An index that lacks the ends of the log and some files inside, a folder that lacks others and has some of another base or none."""
    files = t.file_catalog(t.change_events(spark, sf_dir, keep=True)).select(F.col("file").alias("name"), "file_no")
    low, high = files.agg(F.min("file_no") + 2, F.max("file_no") - 1).first()
    index = files.where(F.col("file_no").between(low or 0, high or 0) & ((F.col("file_no") % 9 != 4) | F.col("file_no").isin(low or 0, high or 0)))
    old = files.where("file_no % 10 = 3").select(F.concat(F.lit("old."), F.lpad(F.col("file_no").cast("string"), 6, "0")).alias("name"))
    parts = files.where("file_no % 10 = 4").select(F.concat("name", F.lit(".part")).alias("name"))
    return checks.reconcile(index, files.where("file_no % 8 <> 5").select("name").unionByName(old).unionByName(parts))


@query(
    """+ files AS (SELECT 'log' AS base, file_no, in_use OR file_no % 10 = 6 AS in_use, CASE WHEN file_no % 11 = 8 THEN 0 ELSE file_no END AS held FROM file_catalog WHERE file_no % 7 <> 3)
  SELECT base, file_no, in_use, CAST(held AS BIGINT) AS held, CASE WHEN file_no <> lag(file_no) OVER w + 1 THEN 'gap' WHEN in_use AND lead(file_no) OVER w IS NOT NULL THEN 'in_use_early' WHEN held < lag(held) OVER w THEN 'not_nested' ELSE 'ok' END AS problem FROM files WINDOW w AS (ORDER BY base, file_no)"""
)
def a13_rebuild_checks(spark, sf_dir):
    files = t.file_catalog(t.change_events(spark, sf_dir)).where("file_no % 7 <> 3")
    rows = files.select(F.lit("log").alias("base"), "file_no", (F.col("in_use") | (F.col("file_no") % 10 == 6)).alias("in_use"), F.when(F.col("file_no") % 11 == 8, 0).otherwise(F.col("file_no")).cast("long").alias("held"))
    return checks.rebuild_checks(rows)


@query("SELECT file AS name, count(*) AS n FROM change_events GROUP BY file HAVING count(*) > 1")
def i4_duplicate_names(spark, sf_dir):
    """An index with a line for each event."""
    return checks.duplicate_names(t.change_events(spark, sf_dir).select(F.col("file").alias("name")))


@query(
    """+ idx AS (SELECT file_no AS ordinal, file AS name FROM file_catalog), gone AS (SELECT file_no AS ordinal, CASE WHEN file_no % 7 = 3 THEN 'log.000099' ELSE file END AS name FROM file_catalog WHERE NOT in_use)
  SELECT g.ordinal, g.name AS purged, i.name AS indexed FROM gone g LEFT JOIN idx i ON i.ordinal = g.ordinal WHERE g.name IS DISTINCT FROM i.name"""
)
def e4_purge_mismatches(spark, sf_dir):
    files = t.file_catalog(t.change_events(spark, sf_dir, keep=True)).select(F.col("file_no").alias("ordinal"), F.col("file").alias("name"), "in_use")
    index = files.drop("in_use")
    gone = files.where("NOT in_use").select("ordinal", F.when(F.col("ordinal") % 7 == 3, "log.000099").otherwise(F.col("name")).alias("name"))
    return checks.purge_mismatches(gone, index)


@query("SELECT file_no, pos FROM change_events WHERE event_id % 61 = 5")
def e9_resume_mismatches(spark, sf_dir):
    stored = t.change_events(spark, sf_dir).select("event_id", "file_no", "pos", F.col("props").alias("body"))
    resent = stored.withColumn("body", F.when(F.col("event_id") % 61 == 5, F.concat("body", F.lit(" "))).otherwise(F.col("body")))
    return checks.resume_mismatches(stored, resent)


@query(
    """+ s AS (SELECT s_name AS name, 1000 * (s_suppkey % 5) AS low, 3000 AS high, 100 * s_nationkey AS reserve, 4000 AS most, 1048576 * (s_suppkey % 4) AS cache FROM supplier)
  SELECT name, 'low_below_high' AS rule FROM s WHERE NOT low < high UNION ALL SELECT name, 'reserve_fits' FROM s WHERE NOT high + reserve <= most
  UNION ALL SELECT name, 'all_positive' FROM s WHERE NOT (low > 0 AND high > 0 AND reserve > 0 AND most > 0) UNION ALL SELECT name, 'cache_at_least_2_mib' FROM s WHERE NOT cache >= 2097152"""
)
def d10_settings_violations(spark, sf_dir):
    s = t.table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_name").alias("name"), (1000 * (F.col("s_suppkey") % 5)).alias("low"), F.lit(3000).alias("high"), (100 * F.col("s_nationkey")).alias("reserve"), F.lit(4000).alias("most"), (checks.MIB * (F.col("s_suppkey") % 4)).alias("cache"))
    return checks.settings_violations(rows)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey * 1000 > 4000 THEN 'cache of ' || s_suppkey * 1000 || ' bytes exceeds memory of 4000' END AS warning FROM supplier", derived=False)
def d16_cache_warning(spark, sf_dir):
    s = t.table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), checks.cache_warning(F.col("s_suppkey") * 1000, F.lit(4000)).alias("warning"))


@query(
    """WITH ends(k, reason, exit_code, again, kind) AS (VALUES (0, 'stopped', 0, false, 'stopped'), (1, 'stopped_by_sink', 0, false, 'stopped'), (2, 'timeout', 3, true, 'stream lost'), (3, 'connection_closed', 3, true, 'stream lost'),
    (4, 'end_of_stream', 3, true, 'stream lost'), (5, 'source_error', 2, true, 'source error'), (6, 'heartbeat_failure', 2, false, 'heartbeat failure'), (7, 'malformed_stream', 2, false, 'malformed stream'), (8, 'else', 2, false, 'unrecognized'))
  SELECT event_id, exit_code, again AND NOT (k = 5 AND user_id % 3 = 0) AS reconnect, kind FROM events JOIN ends ON event_id % 9 = k""",
    derived=False,
)
def d12_stream_ends(spark, sf_dir):
    """Every event ends a stream, for a reason of its number; a third of the sources' errors say that the history is gone."""
    reasons = ["stopped", "stopped_by_sink", "timeout", "connection_closed", "end_of_stream", "source_error", "heartbeat_failure", "malformed_stream", "else"]
    reason = F.element_at(F.array(*map(F.lit, reasons)), (F.col("event_id") % 9 + 1).cast("int"))
    code = F.when(F.col("user_id") % 3 == 0, 1236).when(F.col("user_id") % 3 == 1, 1045)
    return t.table(spark, sf_dir, "events").select("event_id", checks.stream_end_class(reason, code).alias("x")).select("event_id", "x.*")


CUTOFF = "(SELECT max(tsec) - 20 * 86400 FROM change_events)"
PINNED = "CASE WHEN file_no % 23 = 22 THEN 1 ELSE 0 END"


@query(
    f"""+ c AS (SELECT *, {PINNED} AS pins, sum(size) OVER () AS total, coalesce(sum(size) OVER (ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, lead(created_at) OVER (ORDER BY file_no) AS nxt FROM file_catalog),
  m AS (SELECT *, coalesce(nxt IS NOT NULL AND NOT in_use AND on_disk AND pins = 0 AND ((nxt <> 0 AND nxt < {CUTOFF}) OR ((total > 100000 OR 50000 < 60000) AND (total - before > 80000 OR 50000 + before < 60000))), false) AS removable FROM c)
  SELECT file_no, size, CAST(before AS BIGINT) AS before, removable, min(CAST(removable AS INT)) OVER (ORDER BY file_no ROWS UNBOUNDED PRECEDING) = 1 AS removed FROM m"""
)
def g8_purge(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    cutoff = events.agg(F.max("tsec")).first()[0] - 20 * 86400
    files = t.file_catalog(events).withColumn("pins", F.when(F.col("file_no") % 23 == 22, 1).otherwise(0))
    return retention.purge(files, cutoff, high=100_000, low=80_000, available=50_000, min_free=60_000).select("file_no", "size", "before", "removable", "removed")


@query("SELECT file_no, CAST(before AS BIGINT) AS before FROM (SELECT file_no, coalesce(sum(size) OVER (ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM file_catalog) WHERE before >= 90000")
def j10_refused_creations(spark, sf_dir):
    return retention.refused_creations(t.file_catalog(t.change_events(spark, sf_dir)), 100_000, 10_000).select("file_no", "before")


ORIGIN = "(SELECT *, CASE WHEN tsec >= max(tsec) OVER (PARTITION BY file_no) - 3600 THEN 'cache' ELSE 'disk' END AS origin FROM change_events)"


@query(f"SELECT event_id, origin FROM {ORIGIN}")
def j11_cache_window(spark, sf_dir):
    return retention.cache_origin(t.change_events(spark, sf_dir), 3600).select("event_id", "origin")


@query(
    f"SELECT file_no, CAST(sum(CASE WHEN origin = 'cache' THEN len ELSE 0 END) AS BIGINT) AS from_cache, CAST(sum(CASE WHEN origin = 'disk' THEN len ELSE 0 END) AS BIGINT) AS from_disk, count(*) FILTER (WHERE origin = 'cache' AND l = 'disk') AS crossings FROM (SELECT *, lag(origin) OVER (PARTITION BY file_no ORDER BY pos) AS l FROM {ORIGIN}) GROUP BY file_no"
)
def f9_cache_counters(spark, sf_dir):
    return retention.cache_counters(retention.cache_origin(t.change_events(spark, sf_dir), 3600))


@query("SELECT file_no, segment, row_number() OVER (PARTITION BY file_no ORDER BY appended_at, segment) AS turn FROM (SELECT file_no, pos // 1000 AS segment, min(tsec) AS appended_at, bool_or(event_id % 91 = 0) AS pinned, bool_and(event_id % 77 <> 5) AS written FROM change_events GROUP BY file_no, pos // 1000) WHERE NOT pinned AND written")
def h7_eviction_order(spark, sf_dir):
    segments = t.change_events(spark, sf_dir).groupBy("file_no", F.expr("pos div 1000").alias("segment")).agg(F.min("tsec").alias("appended_at"), F.bool_or(F.col("event_id") % 91 == 0).alias("pinned"), F.bool_and(F.col("event_id") % 77 != 5).alias("written"))
    return retention.eviction_order(segments).select("file_no", "segment", "turn")


ROLED = """roled AS (SELECT *, event_type = 'signup' AS opens, event_type = 'error' AS service, CAST(len + coalesce(lead(len, 1) OVER w, 0) + coalesce(lead(len, 2) OVER w, 0) AS BIGINT) AS txn_length FROM change_events WINDOW w AS (PARTITION BY file_no ORDER BY pos)),
  marked AS (SELECT *, last_value(CASE WHEN opens THEN pos END IGNORE NULLS) OVER u AS p, last_value(CASE WHEN opens THEN pos + txn_length END IGNORE NULLS) OVER u AS e FROM roled WINDOW u AS (PARTITION BY file_no ORDER BY pos ROWS UNBOUNDED PRECEDING)),
  grouped AS (SELECT *, CASE WHEN p IS NOT NULL AND pos < e THEN p END AS txn_pos, CASE WHEN opens THEN 'GroupStart' WHEN p IS NULL OR pos >= e THEN 'Standalone' WHEN end_pos = e THEN 'GroupEnd' WHEN end_pos < e THEN 'InGroup' ELSE 'Malformed' END AS outcome FROM marked)"""


def _roled(spark, sf_dir):
    """Stand-in roles: signup opens a transaction that lasts for the two events after it; error is a service event."""
    after = lambda k: F.coalesce(F.lead("len", k).over(transactions.in_file()), F.lit(0))
    return t.change_events(spark, sf_dir).withColumns({"opens": F.col("event_type") == "signup", "service": F.col("event_type") == "error", "txn_length": (F.col("len") + after(1) + after(2)).cast("long")})


@query(f"+ {ROLED} SELECT event_id, txn_pos, outcome FROM grouped")
def g6_transactions(spark, sf_dir):
    return transactions.group_by_length(_roled(spark, sf_dir)).select("event_id", "txn_pos", "outcome")


@query(None)
def g6_strict_transactions(spark, sf_dir):
    return transactions.group_strictly(_roled(spark, sf_dir))


@query(f"+ {ROLED} SELECT file_no, max(end_pos) AS published_pos FROM grouped WHERE outcome IN ('GroupEnd', 'Standalone') GROUP BY file_no")
def j1_published(spark, sf_dir):
    return transactions.published_positions(transactions.group_by_length(_roled(spark, sf_dir)))


@query(
    f"""+ {ROLED}, ends AS (SELECT file_no, max(end_pos) AS size, coalesce(max(end_pos) FILTER (WHERE outcome IN ('GroupEnd', 'Standalone')), 4) AS boundary FROM grouped GROUP BY file_no)
  SELECT file_no, boundary, size - boundary AS tail_bytes, CASE WHEN size = boundary THEN 'keep' WHEN file_no = (SELECT max(file_no) FROM ends) THEN 'truncate' ELSE 'corrupt' END AS action FROM ends"""
)
def j5_recovery(spark, sf_dir):
    events = _roled(spark, sf_dir)
    newest = events.agg(F.max("file_no")).first()[0]
    return transactions.recover(events, transactions.group_by_length(events), newest or 0)


@query("SELECT source, CAST(1 AS BIGINT) AS start, max(gno) + 1 AS \"end\" FROM change_events GROUP BY source")
def f6_executed(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    newest = events.agg(F.max("file_no")).first()[0] or 0
    done = transactions.completed(events.where(F.col("file_no") == newest))
    return transactions.executed(t.previous_sets(events), done, newest)


OLDEST = "oldest AS (SELECT min(file_no) AS n FROM file_catalog WHERE created_at >= (SELECT max(created_at) FROM file_catalog) - 20 * 86400)"


def _oldest(events):
    """The oldest file that a retention of 20 days leaves."""
    files = events.groupBy("file_no").agg(F.min("tsec").alias("created_at"))
    newest = files.agg(F.max("created_at").alias("newest"))
    return files.join(F.broadcast(newest), how="cross").where(F.col("created_at") >= F.col("newest") - 20 * 86400).agg(F.min("file_no")).first()[0] or 0


@query(f'+ {OLDEST} SELECT source, start, "end" FROM previous_sets, oldest WHERE file_no = n')
def f7_purged(spark, sf_dir):
    events = t.change_events(spark, sf_dir, keep=True)
    return transactions.purged(t.previous_sets(events), _oldest(events))


@query(f'+ {OLDEST} SELECT source, CAST(1 AS BIGINT) AS start, max("end") AS "end" FROM previous_sets, oldest WHERE file_no = n OR file_no = (SELECT max(file_no) FROM file_catalog) GROUP BY source')
def j6_start_set(spark, sf_dir):
    """What precedes the oldest file that is left, and what precedes the newest."""
    events = t.change_events(spark, sf_dir, keep=True)
    previous, newest = t.previous_sets(events), events.agg(F.max("file_no")).first()[0] or 0
    side = lambda n: previous.where(F.col("file_no") == n)
    return iv.union_sets(side(_oldest(events)), side(newest), ["source"])


STATUS = """off AS (SELECT file, CAST(coalesce(sum(size) OVER (ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM file_catalog),
  newest AS (SELECT o.before + (SELECT max(end_pos) FROM change_events e WHERE e.file_no = c.file_no AND e.event_type <> 'view') AS at, c.last_at AS clock FROM file_catalog c JOIN off o ON o.file = c.file WHERE c.in_use),
  status AS (SELECT r.*, CASE WHEN NOT dumping THEN 'connected' WHEN idle THEN 'streaming' ELSE 'catching_up' END AS state,
    CASE WHEN dumping AND n.at - o.before - r.pos >= 0 THEN n.at - o.before - r.pos END AS behind_bytes,
    CASE WHEN NOT dumping THEN NULL WHEN idle THEN 0 WHEN tsec = 0 THEN NULL ELSE greatest(n.clock - tsec, 0) END AS behind_seconds FROM replicas r LEFT JOIN off o ON o.file = r.file, newest n)"""
STATE_CODE = "CASE state WHEN 'connected' THEN 0 WHEN 'catching_up' THEN 1 WHEN 'streaming' THEN 2 END"


def _status(spark, sf_dir):
    """Published is, as in a6, the end of the newest file's last event that is no view."""
    events = t.change_events(spark, sf_dir, keep=True)
    catalog = t.file_catalog(events)
    newest = catalog.where("in_use").select("file_no", "file", "last_at").first() or {"file_no": 0, "last_at": None}
    published = events.where((F.col("file_no") == newest["file_no"]) & (F.col("event_type") != "view")).groupBy("file").agg(F.max("end_pos").alias("pos"))
    return status.replica_status(t.replicas(events), cat.with_offsets(catalog), newest["last_at"], published)


@query(f"+ {STATUS} SELECT source, address, state, {STATE_CODE} AS state_code, behind_bytes, CAST(behind_seconds AS BIGINT) AS behind_seconds FROM status")
def f12_replica_status(spark, sf_dir):
    return _status(spark, sf_dir).select("source", "address", "state", "state_code", "behind_bytes", "behind_seconds")


@query(f"+ {STATUS} SELECT state, count(*) AS n, CAST(max(behind_seconds) AS BIGINT) AS worst FROM status GROUP BY state")
def f11_rollup(spark, sf_dir):
    return status.rollup(_status(spark, sf_dir))


@query(
    f"""+ {STATUS} SELECT source, '{{"address":"' || address || '","user":"' || "user" || '","state":"' || state || '","state_code":' || {STATE_CODE} || ',"file":"' || file || '","pos":' || pos || ',"behind_bytes":' || coalesce(CAST(behind_bytes AS VARCHAR), 'null') || ',"behind_seconds":' || coalesce(CAST(behind_seconds AS VARCHAR), 'null') || '}}' AS document FROM status"""
)
def b14_status_documents(spark, sf_dir):
    return status.status_document(_status(spark, sf_dir))


@query(f"+ {STATUS} SELECT source, address, \"user\", CAST(behind_seconds AS BIGINT) AS behind_seconds, {STATE_CODE} AS state_code FROM status")
def k11_monitored_items(spark, sf_dir):
    return status.extract_items(status.status_document(_status(spark, sf_dir)))


@query(f"+ {STATUS} SELECT source, CASE WHEN behind_seconds >= 60 THEN 'bad' WHEN behind_seconds >= 5 THEN 'warn' WHEN behind_seconds IS NOT NULL THEN 'ok' END AS lag, CASE WHEN 100.0 * source / 200 >= 95 THEN 'bad' WHEN 100.0 * source / 200 >= 80 THEN 'warn' ELSE 'ok' END AS fill FROM status")
def c29_thresholds(spark, sf_dir):
    return _status(spark, sf_dir).select("source", status.lag_class(F.col("behind_seconds")).alias("lag"), status.fill_class(F.col("source"), F.lit(200)).alias("fill"))


@query(
    """SELECT event_id, CASE WHEN s >= 86400 THEN s // 86400 || 'd ' ELSE '' END || lpad(CAST(s // 3600 % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS uptime,
    CASE WHEN b >= 1099511627776 THEN ((b * 10 + 549755813888) // 1099511627776) // 10 || '.' || ((b * 10 + 549755813888) // 1099511627776) % 10 || ' TiB' WHEN b >= 1073741824 THEN ((b * 10 + 536870912) // 1073741824) // 10 || '.' || ((b * 10 + 536870912) // 1073741824) % 10 || ' GiB'
      WHEN b >= 1048576 THEN ((b * 10 + 524288) // 1048576) // 10 || '.' || ((b * 10 + 524288) // 1048576) % 10 || ' MiB' WHEN b >= 1024 THEN ((b * 10 + 512) // 1024) // 10 || '.' || ((b * 10 + 512) // 1024) % 10 || ' KiB' ELSE b || ' B' END AS size
  FROM (SELECT event_id, event_id * 37 AS s, event_id * event_id * 977 AS b FROM events)""",
    derived=False,
)
def c28_formatted(spark, sf_dir):
    e = F.col("event_id")
    return t.table(spark, sf_dir, "events").select("event_id", status.duration_text(e * 37).alias("uptime"), status.bytes_text(e * e * 977).alias("size"))


@query(
    "SELECT source, event_id, tsec, min(value) OVER r AS least, max(value) OVER r AS most, count(*) OVER r AS n, lag(value, 5) OVER o AS earlier, tsec - lag(tsec) OVER o > 7200 AS silent FROM change_events WINDOW r AS (PARTITION BY source ORDER BY tsec RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW), o AS (PARTITION BY source ORDER BY tsec, event_id)"
)
def g10_alert_windows(spark, sf_dir):
    return status.alert_windows(t.change_events(spark, sf_dir), "source", 7200, 5)


@query("SELECT event_type, list_sort(list(len))[CAST(floor(0.5 * (count(*) - 1)) AS BIGINT) + 1] AS p50, list_sort(list(len))[CAST(floor(0.99 * (count(*) - 1)) AS BIGINT) + 1] AS p99, max(len) AS largest FROM change_events GROUP BY event_type")
def f13_percentiles(spark, sf_dir):
    return status.percentiles(t.change_events(spark, sf_dir), "event_type", "len")


@query("SELECT file_no, count(*) AS events, count(*) FILTER (WHERE event_type = 'view') AS heartbeats, count(*) FILTER (WHERE event_type = 'error') AS artificial, CAST(sum(len) AS BIGINT) AS bytes, max(len) AS largest FROM change_events GROUP BY file_no")
def f3_stream_counters(spark, sf_dir):
    return status.stream_counters(t.change_events(spark, sf_dir), "file_no", ["view"], ["error"])


@query("SELECT arg_min(file, event_id) AS first_file, arg_min(pos, event_id) AS first_pos, arg_max(file, event_id) AS last_file, arg_max(end_pos, event_id) AS last_pos, count(*) AS events, CAST(sum(len) AS BIGINT) AS bytes FROM change_events")
def b17_stream_summary(spark, sf_dir):
    return status.stream_summary(t.change_events(spark, sf_dir))


@query("SELECT event_id AS session, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 AS holds FROM events", derived=False)
def e10_latest_sessions(spark, sf_dir):
    sessions = t.table(spark, sf_dir, "events").select(F.col("event_id").alias("session"), "user_id", F.col("ts").alias("since"))
    return status.latest_sessions(sessions, "user_id").select("session", "user_id", "holds")


@query(
    """SELECT s_suppkey AS id, CAST(s_suppkey * [1, 1024, 1048576, 1073741824][CAST(s_suppkey % 4 AS INT) + 1] AS DECIMAL(20,0)) AS bytes, nullif(s_suppkey * [1, 60, 3600, 86400][CAST(s_suppkey % 4 AS INT) + 1], 0) AS seconds, s_suppkey * [1, 1000][CAST(s_suppkey % 2 AS INT) + 1] AS micros FROM supplier""",
    derived=False,
)
def c19_sizes_and_durations(spark, sf_dir):
    k = F.col("s_suppkey")
    pick = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (k % n + 1).cast("int"))
    return t.table(spark, sf_dir, "supplier").select(
        k.alias("id"),
        parse.byte_size(F.concat(k, pick(("", "K", "m", "G"), 4))).alias("bytes"),
        parse.duration_seconds(F.concat(k, pick(("s", "m", "h", "d"), 4))).alias("seconds"),
        parse.delay_microseconds(F.concat(k, pick(("us", "ms"), 2))).alias("micros"),
    )


@query(
    "SELECT c_custkey AS id, 167772160 + c_custkey * 997 % 65536 AS number, c_custkey * 997 % 65536 // 256 = c_nationkey AS inside FROM customer",
    derived=False,
)
def d8_address_ranges(spark, sf_dir):
    low = F.col("c_custkey") * 997 % 65536
    text = F.concat_ws(".", F.lit("10"), F.lit("0"), F.expr("(c_custkey * 997 % 65536) div 256").cast("string"), (low % 256).cast("string"))
    network = F.concat_ws(".", F.lit("10"), F.lit("0"), F.col("c_nationkey").cast("string"), F.lit("0"))
    number = parse.ipv4_number(text)
    return t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), number.alias("number"), parse.in_ipv4_range(number, parse.ipv4_number(network), F.lit(24)).alias("inside"))


@query("SELECT c_custkey AS id FROM customer c WHERE EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = c.c_nationkey AND c_custkey % 1000 // 8 = s_suppkey % 1000 // 8)", derived=False)
def e6_clients_in_ranges(spark, sf_dir):
    """The client join: a user, equal on both sides, and a range of addresses that has the client's. Hashed on the user, the range is the condition."""
    clients = t.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user"), (F.col("c_custkey") % 1000).alias("address"))
    ranges = t.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("r_user"), (F.col("s_suppkey") % 1000).alias("network"))
    inside = parse.in_ipv4_range(F.col("address"), F.col("network"), F.lit(29))
    return clients.join(ranges, (F.col("user") == F.col("r_user")) & inside, "left_semi").select("id")


@query(
    """+ running AS (SELECT c_name AS "user", c_mktsegment AS secret, c_nationkey % 5 AS hosts FROM customer WHERE c_custkey % 10 <> 1), loaded AS (SELECT c_name AS "user", CASE WHEN c_custkey % 10 = 2 THEN 'x' ELSE c_mktsegment END AS secret, CASE WHEN c_custkey % 10 = 3 THEN 9 ELSE c_nationkey % 5 END AS hosts FROM customer WHERE c_custkey % 10 <> 4)
  SELECT coalesce(r."user", l."user") AS "user", CASE WHEN l."user" IS NULL THEN 'removed' WHEN r."user" IS NULL THEN 'added' WHEN r.secret <> l.secret THEN 'password' WHEN r.hosts <> l.hosts THEN 'hosts' ELSE 'same' END AS change FROM running r FULL JOIN loaded l ON r."user" = l."user" """
)
def e5_reload_changes(spark, sf_dir):
    c, k = t.table(spark, sf_dir, "customer"), F.col("c_custkey") % 10
    running = c.where(k != 1).select(F.col("c_name").alias("user"), F.col("c_mktsegment").alias("secret"), (F.col("c_nationkey") % 5).alias("hosts"))
    loaded = c.where(k != 4).select(F.col("c_name").alias("user"), F.when(k == 2, "x").otherwise(F.col("c_mktsegment")).alias("l_secret"), F.when(k == 3, 9).otherwise(F.col("c_nationkey") % 5).alias("l_hosts"))
    change = F.when(F.col("l_secret").isNull(), "removed").when(F.col("secret").isNull(), "added").when(F.col("secret") != F.col("l_secret"), "password").when(F.col("hosts") != F.col("l_hosts"), "hosts").otherwise("same")
    return running.join(loaded, "user", "full_outer").select("user", change.alias("change"))


@query("SELECT event_id, tsec AS timestamp, len % 256 AS type, source AS server_id, len AS event_length, end_pos & 4294967295 AS next_pos, CAST(event_id % 40 AS BIGINT) AS flags FROM change_events")
def c1_header_round_trip(spark, sf_dir):
    """Headers are written as 19 bytes and read back."""
    events = t.change_events(spark, sf_dir)
    head = decode.header_bytes(F.col("tsec"), F.col("len") % 256, F.col("source"), F.col("len"), F.col("end_pos").bitwiseAND(F.lit(0xFFFFFFFF)), F.col("event_id") % 40)
    return events.select("event_id", head.alias("h")).select("event_id", *decode.header_fields(F.col("h")))


@query("SELECT file_no, size AS position, file AS name FROM file_catalog")
def c9_rotate_round_trip(spark, sf_dir):
    files = t.file_catalog(t.change_events(spark, sf_dir))
    return files.select("file_no", decode.rotate_bytes(F.col("size"), F.col("file")).alias("b")).select("file_no", *decode.rotate_fields(F.col("b")))


@query("SELECT source, md5(CAST(source AS VARCHAR)) AS hex, start, \"end\" FROM " + "(SELECT source, min(gno) AS start, max(gno) + 1 AS \"end\" FROM (SELECT source, gno, gno - row_number() OVER (PARTITION BY source ORDER BY gno) AS run FROM change_events WHERE event_type <> 'error') GROUP BY source, run)")
def c18_set_codec(spark, sf_dir):
    """Sets are written in the binary form, a source each, and read back."""
    runs = iv.numbers_to_intervals(t.change_events(spark, sf_dir).where("event_type <> 'error'"), ["source"])
    number = lambda c: decode.encoded_number(c, 8)
    pairs = F.aggregate(F.array_sort(F.collect_list(F.struct("start", "end"))), F.unhex(F.lit("")), lambda s, x: F.concat(s, number(x["start"]), number(x["end"])))
    uuid = F.unhex(F.md5(F.col("source").cast("string").cast("binary")))
    sets = runs.groupBy("source").agg(pairs.alias("p"), F.count(F.lit(1)).alias("n"))
    encoded = sets.select("source", F.concat(number(F.lit(1)), uuid, number(F.col("n")), "p").alias("b"))
    return decode.decode_sets(encoded, "source", "b").select("source", F.lower(F.hex("uuid")).alias("hex"), "start", "end")


@query("SELECT event_id, md5(CAST(source AS VARCHAR)) AS hex, gno FROM change_events")
def c6_transaction_bodies(spark, sf_dir):
    """Bodies of transaction events are written (flags, uuid, number) and decoded in Arrow batches."""
    events = t.change_events(spark, sf_dir)
    body = F.concat(F.unhex(F.lit("01")), F.unhex(F.md5(F.col("source").cast("string").cast("binary"))), decode.encoded_number(F.col("gno"), 8))
    return decode.decode_transactions(events.select("event_id", body.alias("b")), "event_id", "b").select("event_id", F.lower(F.hex("uuid")).alias("hex"), "gno")


@query("SELECT source, md5(CAST(source AS VARCHAR))[1:8] || '-' || md5(CAST(source AS VARCHAR))[9:12] || '-' || md5(CAST(source AS VARCHAR))[13:16] || '-' || md5(CAST(source AS VARCHAR))[17:20] || '-' || md5(CAST(source AS VARCHAR))[21:32] AS uuid FROM held")
def c14_uuid_round_trip(spark, sf_dir):
    text = parse.uuid_text(F.unhex(F.md5(F.col("source").cast("string").cast("binary"))))
    return t.held_set(t.change_events(spark, sf_dir)).select("source", parse.uuid_text(parse.uuid_bytes(F.upper(text))).alias("uuid"))


@query(
    "SELECT o_orderkey AS id, CAST((o_orderkey % 9) * 10000 + (o_orderkey % 7) * 100 + o_orderkey % 50 AS BIGINT) AS number, CAST((o_orderkey % 9) * 65536 + (o_orderkey % 7) * 256 + o_orderkey % 50 AS BIGINT) AS product, CASE WHEN (o_orderkey % 9) * 65536 + (o_orderkey % 7) * 256 + o_orderkey % 50 < 329217 THEN 'UNDEF' WHEN o_orderkey % 3 = 0 THEN 'OFF' WHEN o_orderkey % 3 = 1 THEN 'CRC32' ELSE 'UNKNOWN(2)' END AS checksum FROM orders",
    derived=False,
)
def c3_versions(spark, sf_dir):
    k = F.col("o_orderkey")
    version = F.concat_ws(".", (k % 9).cast("string"), (k % 7).cast("string"), (k % 50).cast("string"))
    product = parse.version_product(version)
    return t.table(spark, sf_dir, "orders").select(k.alias("id"), parse.version_number(version).alias("number"), product.alias("product"), parse.checksum_name(k % 3, product).alias("checksum"))


@query("SELECT p_partkey AS id, CASE WHEN regexp_matches(p_brand, '^[A-Za-z_][A-Za-z0-9_]{0,31}$') THEN lower(p_brand) END AS tag FROM part", derived=False)
def c15_tags(spark, sf_dir):
    return t.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), parse.tag(F.col("p_brand")).alias("tag"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+(/[^ ?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query FROM pages WHERE regexp_matches(url, '^[a-z]+://[^/]+/')", derived=False)
def c31_request_lines(spark, sf_dir):
    target = F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^#]*)", 1)
    lines = t.table(spark, sf_dir, "pages").where(F.col("url").rlike("^[a-z]+://[^/]+/")).select("page_id", parse.request_line(F.concat(F.lit("GET "), target, F.lit(" HTTP/1.1"))).alias("r"))
    return lines.select("page_id", F.col("r.path").alias("path"), F.col("r.query").alias("query"))


@query(
    """SELECT event_id, CASE event_type WHEN 'click' THEN 'select' WHEN 'view' THEN 'set' WHEN 'error' THEN 'unsupported' ELSE 'show_events' END AS kind, CASE event_type WHEN 'click' THEN ['@@server_id', '@u' || user_id, 'VERSION()'] END AS items FROM events""",
    derived=False,
)
def k1_statements(spark, sf_dir):
    """Statements of each kind, made from the events, are told apart; a list of variables is split."""
    e, u = F.col("event_type"), F.col("user_id").cast("string")
    sql = F.when(e == "click", F.concat(F.lit("select @@server_id, @u"), u, F.lit(" , VERSION() LIMIT 1"))).when(e == "view", F.concat(F.lit("SET @u = "), u)).when(e == "error", F.lit("DELETE FROM t")).otherwise(F.lit("show binlog events in 'log.000001' limit 1,1"))
    kind = parse.statement_kind(F.col("sql"))
    return t.table(spark, sf_dir, "events").select("event_id", sql.alias("sql")).select("event_id", kind.alias("kind"), F.when(kind == "select", parse.select_items(F.col("sql"))).alias("items"))


@query(
    """SELECT 'server_id' AS name, CAST(count(DISTINCT source) AS VARCHAR) AS value FROM change_events UNION ALL SELECT 'gtid_mode', 'ON' UNION ALL
  SELECT 'gtid_executed', string_agg(source || ':1' || CASE WHEN n = 1 THEN '' ELSE '-' || n END, ',' ORDER BY source) FROM (SELECT source, max(gno) AS n FROM change_events GROUP BY source) UNION ALL
  SELECT 'last_file', max(file) FROM file_catalog"""
)
def k3_system_variables(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    last = events.groupBy("source").agg(F.max("gno").alias("n"))
    one = F.concat(F.col("source"), F.lit(":1"), F.when(F.col("n") == 1, F.lit("")).otherwise(F.concat(F.lit("-"), "n")))
    executed = last.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", one.alias("t")))), lambda x: x["t"]), ",").alias("value"))
    named = lambda name, df: df.select(F.lit(name).alias("name"), F.col("value").cast("string").alias("value"))
    ids = named("server_id", events.agg(F.count_distinct("source").alias("value")))
    mode = named("gtid_mode", events.agg(F.lit("ON").alias("value")))
    return ids.unionByName(mode).unionByName(named("gtid_executed", executed)).unionByName(named("last_file", events.agg(F.max("file").alias("value"))))


@query("SELECT file_no, 4 AS log_version, '8.' || file_no % 5 || '.' || file_no AS server_version, created_at AS created, 19 AS header_length, file_no % 2 = 0 AS same FROM file_catalog")
def c2_descriptions(spark, sf_dir):
    """Format descriptions are written and read back, and compared with ones sent again (c5)."""
    files = t.file_catalog(t.change_events(spark, sf_dir))
    version = F.concat_ws(".", F.lit("8"), (F.col("file_no") % 5).cast("string"), F.col("file_no").cast("string"))
    again = F.when(F.col("file_no") % 2 == 0, version).otherwise(F.lit("5.7.1"))
    bodies = files.select("file_no", decode.description_bytes(version, F.col("created_at"), F.lit(1)).alias("b"), decode.description_bytes(again, F.col("created_at") + 9, F.lit(1)).alias("r"))
    return bodies.select("file_no", *decode.description_fields(F.col("b")), decode.equal_for_resume(F.col("b"), F.col("r")).alias("same"))


@query("SELECT event_id, md5(CAST(source AS VARCHAR)) AS hex, gno, event_type AS tag, CASE WHEN event_id % 3 > 0 THEN len * 1000 END AS txn_length FROM change_events")
def c7_tagged_bodies(spark, sf_dir):
    """Bodies of tagged transactions are written and decoded."""
    events = t.change_events(spark, sf_dir).select("event_id", F.unhex(F.md5(F.col("source").cast("string").cast("binary"))).alias("u"), "gno", "event_type", F.when(F.col("event_id") % 3 > 0, F.col("len") * 1000).alias("length"))
    written = decode.map_bodies(events, "event_id", ["u", "gno", "event_type", "length"], lambda *x: (decode.tagged_bytes(*x),), "b binary")
    fields = decode.map_bodies(written, "event_id", ["b"], decode.tagged_fields, "uuid binary, gno long, tag string, txn_length long")
    return fields.select("event_id", F.lower(F.hex("uuid")).alias("hex"), "gno", "tag", "txn_length")


@query("SELECT event_id, file AS name, pos * 70000 AS position FROM change_events")
def c10_heartbeats(spark, sf_dir):
    """Heartbeats of the second form are written and decoded."""
    events = t.change_events(spark, sf_dir).select("event_id", "file", (F.col("pos") * 70000).alias("p"))
    written = decode.map_bodies(events, "event_id", ["file", "p"], lambda *x: (decode.heartbeat_bytes(*x),), "b binary")
    return decode.map_bodies(written, "event_id", ["b"], decode.heartbeat_fields, "name string, position long")
