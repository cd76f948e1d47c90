"""Queries over positions, catalogues, sets and dumps, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import catalog as cat
from ..operators import dump as dmp
from ..operators import intervals as iv
from ..sources import tables as t

QUERY = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, QUERY] = {}
_SQL: dict[str, str] = {}

#: Stand-ins: the types that decide whether a transaction is skipped, and a service event.
DECIDING = ["signup", "error"]


def query(sql: str | None, derived: bool = True):
    """Registers a query under its function's name, with its SQL over the derived tables or the given ones."""

    def add(f: QUERY) -> QUERY:
        _Q[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = t.with_derived(sql) if derived else sql
        return f

    return add


def queries() -> dict[str, QUERY]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@query("SELECT event_id, file, pos, end_pos, len FROM change_events")
def g1_running_positions(spark, sf_dir):
    return t.change_events(spark, sf_dir).select("event_id", "file", "pos", "end_pos", "len")


@query("SELECT file_no, file, size, created_at, events, in_use FROM file_catalog")
def a9_file_catalog(spark, sf_dir):
    return t.file_catalog(t.change_events(spark, sf_dir)).select("file_no", "file", "size", "created_at", "events", "in_use")


@query('SELECT file_no, source, start, "end" FROM previous_sets')
def a19_previous_sets(spark, sf_dir):
    return t.previous_sets(t.change_events(spark, sf_dir))


@query('SELECT e.event_id, e.source, e.gno, e.file, e.pos, e.len FROM change_events e WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.source = e.source AND e.gno >= h.start AND e.gno < h."end")')
def dump_needed_events(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    return dmp.needed_events(events, t.held_set(events)).select("event_id", "source", "gno", "file", "pos", "len")


@query('SELECT e.event_id, e.source, e.gno FROM change_events e JOIN held h ON h.source = e.source AND e.gno >= h.start AND e.gno < h."end"')
def d1_contained_events(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    return iv.covered(events, t.held_set(events), ["source"], "left_semi").select("event_id", "source", "gno")


RUNS = """(SELECT source, min(gno) AS start, max(gno) + 1 AS "end" FROM (
  SELECT source, gno, gno - row_number() OVER (PARTITION BY source ORDER BY gno) AS run FROM change_events WHERE {where}) GROUP BY source, run)"""


@query("SELECT source, start, \"end\" FROM " + RUNS.format(where="event_type <> 'error'"))
def f8_completed_sets(spark, sf_dir):
    return iv.numbers_to_intervals(t.change_events(spark, sf_dir).where("event_type <> 'error'"), ["source"])


@query(
    """+ line AS (SELECT l_suppkey AS k, epoch(l_shipdate)::BIGINT // 86400 AS start, epoch(l_shipdate)::BIGINT // 86400 + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem),
  marked AS (SELECT *, max("end") OVER (PARTITION BY k ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM line),
  runs AS (SELECT *, sum(CASE WHEN pm IS NULL OR start > pm THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS run FROM marked)
  SELECT k, min(start) AS start, max("end") AS "end" FROM runs GROUP BY k, run"""
)
def f1_interval_union(spark, sf_dir):
    days = F.expr(f"timestampdiff(DAY, {t.EPOCH}, l_shipdate)")
    line = t.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), days.alias("start"), (days + F.col("l_quantity").cast("long")).alias("end"))
    return iv.merge_intervals(line, ["k"])


@query("SELECT source, CAST(1 AS BIGINT) AS start, greatest(max(h_end), max(g_end)) AS \"end\" FROM (SELECT source, \"end\" AS h_end, 0 AS g_end FROM held UNION ALL SELECT source, 0, gno + 1 FROM change_events) GROUP BY source")
def f2_set_union(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    return iv.union_sets(t.held_set(events), iv.numbers_to_intervals(events, ["source"]), ["source"])


@query('SELECT p.file_no, p.source, p.start, p."end" FROM previous_sets p WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.source = p.source AND p.start >= h.start AND p."end" <= h."end")')
def d2_uncovered_intervals(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    return iv.uncovered_intervals(t.previous_sets(events), t.held_set(events), ["source"])


@query("SELECT source, count(*) AS intervals, CAST(sum(\"end\" - start) AS BIGINT) AS numbers FROM " + RUNS.format(where="event_type <> 'error'") + " GROUP BY source")
def i3_by_source(spark, sf_dir):
    runs = iv.numbers_to_intervals(t.change_events(spark, sf_dir).where("event_type <> 'error'"), ["source"])
    return runs.groupBy("source").agg(F.count(F.lit(1)).alias("intervals"), F.sum(F.col("end") - F.col("start")).cast("long").alias("numbers"))


@query(
    """+ lacking AS (SELECT DISTINCT p.file_no FROM previous_sets p WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.source = p.source AND p.start >= h.start AND p."end" <= h."end"))
  SELECT file_no, file, size FROM file_catalog WHERE file_no NOT IN (SELECT file_no FROM lacking) ORDER BY file_no DESC LIMIT 1"""
)
def e2_start_file(spark, sf_dir):
    events = t.change_events(spark, sf_dir, keep=True)
    return cat.start_file(t.file_catalog(events), t.previous_sets(events), t.held_set(events)).select("file_no", "file", "size")


@query("SELECT file_no, file, size, CAST(coalesce(sum(size) OVER (ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM file_catalog")
def g5_bytes_before(spark, sf_dir):
    return cat.with_offsets(t.file_catalog(t.change_events(spark, sf_dir))).select("file_no", "file", "size", "before")


@query("SELECT file, lead(file) OVER w AS next_file, lead(created_at) OVER w AS next_created_at, lead(file) OVER w IS NOT NULL AND NOT in_use AS may_follow FROM file_catalog WINDOW w AS (ORDER BY file_no)")
def g4_successors(spark, sf_dir):
    return cat.with_neighbours(t.file_catalog(t.change_events(spark, sf_dir))).select("file", "next_file", "next_created_at", "may_follow")


@query("SELECT count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, min(file) AS first_file, max(file) AS last_file FROM file_catalog")
def f4_storage_totals(spark, sf_dir):
    return cat.totals(t.file_catalog(t.change_events(spark, sf_dir)))


@query(
    """+ off AS (SELECT file, CAST(coalesce(sum(size) OVER (ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM file_catalog),
  newest AS (SELECT file AS to_file, size AS to_pos FROM file_catalog WHERE in_use),
  pairs AS (SELECT source, CASE WHEN source % 7 = 0 THEN 'log.999999' ELSE file END AS from_file, pos + CASE WHEN source % 11 = 0 THEN 1000000000000 ELSE 0 END AS from_pos, to_file, to_pos FROM replicas, newest)
  SELECT source, from_file, from_pos, CASE WHEN b.before + to_pos - a.before - from_pos >= 0 THEN b.before + to_pos - a.before - from_pos END AS distance
  FROM pairs LEFT JOIN off a ON a.file = from_file LEFT JOIN off b ON b.file = to_file"""
)
def e7_byte_distance(spark, sf_dir):
    events = t.change_events(spark, sf_dir, keep=True)
    catalog = t.file_catalog(events)
    newest = catalog.where("in_use").select(F.col("file").alias("to_file"), F.col("size").alias("to_pos"))
    unknown = F.when(F.col("source") % 7 == 0, "log.999999").otherwise(F.col("file"))
    ahead = F.col("pos") + F.when(F.col("source") % 11 == 0, 1_000_000_000_000).otherwise(0)
    # one row, the newest file
    pairs = t.replicas(events).select("source", unknown.alias("from_file"), ahead.alias("from_pos")).join(F.broadcast(newest), how="cross")
    return cat.bytes_between(pairs, catalog).select("source", "from_file", "from_pos", "distance")


@query("SELECT event_id, pos, len FROM change_events WHERE file_no = 2 AND pos >= 500 AND pos < least(500 + 4000, (SELECT size FROM file_catalog WHERE file_no = 2))")
def a5_range_read(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    return cat.read_range(events, 2, 500, 4000, F.lit(2**62)).select("event_id", "pos", "len")


@query("SELECT c.file_no, c.file, least(c.size, coalesce(p.published_pos, c.size)) AS boundary FROM file_catalog c LEFT JOIN (SELECT file_no, max(end_pos) AS published_pos FROM change_events WHERE event_type <> 'view' GROUP BY file_no) p ON p.file_no = c.file_no")
def a6_read_boundaries(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    published = events.where("event_type <> 'view'").groupBy("file_no").agg(F.max("end_pos").alias("published_pos"))
    return cat.read_boundaries(t.file_catalog(events), published).select("file_no", "file", "boundary")


FLAGGED = """flagged AS (SELECT *, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY file_no ORDER BY pos ROWS UNBOUNDED PRECEDING), false) AS skipped FROM (
  SELECT e.*, CASE WHEN e.event_type IN ('signup', 'error') THEN h.source IS NOT NULL END AS d FROM change_events e LEFT JOIN held h ON h.source = e.source AND e.gno >= h.start AND e.gno < h."end"))"""


START_FILE = """lacking AS (SELECT DISTINCT p.file_no FROM previous_sets p WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.source = p.source AND p.start >= h.start AND p."end" <= h."end")),
  start_ AS (SELECT max(file_no) AS n FROM file_catalog WHERE file_no NOT IN (SELECT file_no FROM lacking))"""


@query(f"+ {FLAGGED} SELECT event_id, file_no, pos, skipped FROM flagged")
def g7_skip_state(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    return dmp.skip_flags(events, t.held_set(events), DECIDING).select("event_id", "file_no", "pos", "skipped")


@query(f"+ {FLAGGED} SELECT file_no, count(*) FILTER (WHERE NOT skipped) AS sent, count(*) FILTER (WHERE skipped) AS skipped, CAST(sum(CASE WHEN skipped THEN 0 ELSE len END) AS BIGINT) AS sent_bytes FROM flagged GROUP BY file_no")
def f10_dump_totals(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    return dmp.dump_totals(dmp.skip_flags(events, t.held_set(events), DECIDING))


@query(
    f"""+ {FLAGGED}, {START_FILE}, runs AS (SELECT *, skipped AND NOT coalesce(lead(skipped) OVER (PARTITION BY file_no ORDER BY pos), false) AS last_one FROM flagged WHERE file_no >= (SELECT n FROM start_))
  SELECT file_no, CASE WHEN skipped THEN end_pos ELSE pos END AS pos, CASE WHEN skipped THEN 'heartbeat' ELSE 'event' END AS kind, CASE WHEN NOT skipped THEN event_id END AS event_id,
    CASE WHEN skipped THEN end_pos ELSE pos END & 4294967295 AS pos32 FROM runs WHERE NOT skipped OR last_one
  UNION ALL SELECT file_no, 4, 'rotate', NULL, 4 FROM file_catalog WHERE file_no >= (SELECT n FROM start_)"""
)
def b11_dump(spark, sf_dir):
    """What is sent from the file on that e2 finds."""
    events = t.change_events(spark, sf_dir, keep=True)
    held, catalog = t.held_set(events), t.file_catalog(events)
    first = cat.start_file(catalog, t.previous_sets(events), held).first()
    return dmp.dump(dmp.skip_flags(events, held, DECIDING), catalog, first["file_no"] if first else 0)


@query(
    """+ gaps AS (SELECT file_no, end_pos, tsec, lead(tsec) OVER (PARTITION BY file_no ORDER BY pos) AS nxt FROM change_events)
  SELECT file_no, end_pos AS pos, unnest(range(tsec + 120, nxt, 120)) AS due FROM gaps WHERE nxt - tsec > 120"""
)
def j7_idle_heartbeats(spark, sf_dir):
    return dmp.idle_heartbeats(t.change_events(spark, sf_dir), 120)


@query(
    """+ left_over AS (SELECT file_no FROM file_catalog WHERE file_no > (SELECT max(file_no) // 5 FROM file_catalog)),
  requests AS (SELECT source % 10 AS r, source <> 5 AS ok_text, CASE WHEN source = 7 THEN -7 ELSE source END AS source, CASE WHEN source % 10 = 6 THEN 2 ELSE start END AS start, "end" + source % 10 AS "end" FROM held
    UNION ALL SELECT r, true, source, 1, 1000000000 FROM (SELECT DISTINCT source % 10 AS r FROM held) a, (SELECT source FROM held) b WHERE r IN (3, 4, 8) AND source % 10 <> r AND NOT (r = 4 AND source = 2)),
  lacking AS (SELECT DISTINCT a.r, p.file_no FROM (SELECT DISTINCT r FROM requests) a, previous_sets p WHERE NOT EXISTS (SELECT 1 FROM requests q WHERE q.r = a.r AND q.source = p.source AND q.start <= p.start AND q."end" >= p."end")),
  starts AS (SELECT a.r, max(f.file_no) AS start_no FROM (SELECT DISTINCT r FROM requests) a, left_over f WHERE NOT EXISTS (SELECT 1 FROM lacking l WHERE l.r = a.r AND l.file_no = f.file_no) GROUP BY a.r),
  decided AS (SELECT q.r, CASE WHEN NOT bool_and(ok_text) THEN 'bad_set' WHEN bool_or(q.source = -7) THEN 'own_uuid' WHEN any_value(s.start_no) IS NULL THEN 'purged' ELSE 'ok' END AS decision, any_value(s.start_no) AS start_no
    FROM requests q LEFT JOIN starts s ON s.r = q.r GROUP BY q.r)
  SELECT CAST(r AS BIGINT) AS address, decision, CASE WHEN decision = 'ok' THEN start_no END AS start_no FROM decided"""
)
def d11_start_decisions(spark, sf_dir):
    """Requests of ten addresses to a log whose oldest fifth is gone: some hold the sources of their address, some nearly all."""
    events = t.change_events(spark, sf_dir, keep=True)
    held, source, own = t.held_set(events), F.col("source"), F.col("source") % 10
    newest = events.agg(F.max("file_no")).first()[0] or 0
    left = t.file_catalog(events).where(F.col("file_no") > newest // 5)
    few = held.select(own.alias("address"), (source != 5).alias("ok_text"), F.when(source == 7, -7).otherwise(source).cast("long").alias("source"), F.when(own == 6, 2).otherwise(F.col("start")).cast("long").alias("start"), (F.col("end") + own).alias("end"))
    # ten addresses, three of which hold nearly every source
    addresses = held.select(own.alias("address")).distinct().where(F.col("address").isin(3, 4, 8))
    most = held.select("source").join(F.broadcast(addresses), (source % 10 != F.col("address")) & ~((F.col("address") == 4) & (source == 2)))
    every = most.select("address", F.lit(True).alias("ok_text"), "source", F.lit(1).cast("long").alias("start"), F.lit(1_000_000_000).cast("long").alias("end"))
    return dmp.start_decision(few.unionByName(every), t.previous_sets(events), left, own_source=-7)


@query("SELECT file_no, 33 & ~1 AS flags, CAST(CASE WHEN file_no % 2 = 0 THEN 0 ELSE created_at END AS BIGINT) AS created FROM file_catalog")
def b13_description_rewrite(spark, sf_dir):
    rows = t.file_catalog(t.change_events(spark, sf_dir)).select("file_no", F.lit(33).alias("flags"), F.col("created_at").alias("created"))
    return dmp.rewrite_description(rows, F.col("file_no") % 2 == 0).drop("checksum")


SET_TEXT = """SELECT source, string_agg(CASE WHEN "end" = start + 1 THEN CAST(start AS VARCHAR) ELSE start || '-' || ("end" - 1) END, ':' ORDER BY start) AS text FROM """


@query(SET_TEXT + RUNS.format(where="event_type <> 'error'") + " GROUP BY source")
def c17_set_text(spark, sf_dir):
    runs = iv.numbers_to_intervals(t.change_events(spark, sf_dir).where("event_type <> 'error'"), ["source"])
    return runs.groupBy("source").agg(parse.set_text(F.collect_list(F.struct("start", "end"))).alias("text"))


@query('SELECT source, start, "end" FROM ' + RUNS.format(where="event_type <> 'error'"))
def c16_set_round_trip(spark, sf_dir):
    text = c17_set_text(spark, sf_dir).select("source", F.explode(parse.set_intervals(F.concat(F.lit("s:"), "text"))).alias("x"))
    return text.select("source", "x.start", "x.end")


@query("SELECT file, split_part(file, '.', 1) AS base, CAST(split_part(file, '.', 2) AS BIGINT) AS number, regexp_matches(file, '^[^/]+\\.[0-9]{6,}$') AS safe FROM file_catalog")
def c13_file_names(spark, sf_dir):
    from ..operators.checks import is_safe_name

    files = t.file_catalog(t.change_events(spark, sf_dir))
    return files.select("file", parse.file_base(F.col("file")).alias("base"), parse.file_number(F.col("file")).alias("number"), is_safe_name(F.col("file")).alias("safe"))


@query("SELECT file_no, min(file) AS file, CAST(count(*) AS BIGINT) AS n, max(gno) AS newest FROM change_events WHERE file_no = (SELECT max(file_no) FROM change_events) GROUP BY file_no")
def h3_last_file(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    last = events.agg(F.max("file_no").alias("file_no"))
    return events.join(F.broadcast(last), "file_no", "left_semi").groupBy("file_no").agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("n"), F.max("gno").alias("newest"))


@query("SELECT event_id, file, pos, event_type, source FROM change_events WHERE file_no = 1 ORDER BY pos LIMIT 1 OFFSET 1")
def h6_second_event(spark, sf_dir):
    events = t.change_events(spark, sf_dir).where("file_no = 1").orderBy("pos").offset(1).limit(1)
    return events.select("event_id", "file", "pos", "event_type", "source")


@query("SELECT c.file AS log_name, CAST(4 AS BIGINT) AS pos, 'Previous_gtids' AS event_type, c.size AS end_log_pos, coalesce(string_agg(p.source || ':' || p.start || CASE WHEN p.\"end\" = p.start + 1 THEN '' ELSE '-' || (p.\"end\" - 1) END, ',' ORDER BY p.source), '') AS info FROM file_catalog c LEFT JOIN previous_sets p ON p.file_no = c.file_no GROUP BY c.file, c.size")
def k5_event_listing(spark, sf_dir):
    events = t.change_events(spark, sf_dir)
    catalog, previous = t.file_catalog(events), t.previous_sets(events)
    one = F.concat(F.col("source"), F.lit(":"), F.col("start"), F.when(F.col("end") == F.col("start") + 1, F.lit("")).otherwise(F.concat(F.lit("-"), F.col("end") - 1)))
    info = previous.groupBy("file_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", one.alias("t")))), lambda x: x["t"]), ",").alias("info"))
    return catalog.join(info, "file_no", "left").select(F.col("file").alias("log_name"), F.lit(4).cast("long").alias("pos"), F.lit("Previous_gtids").alias("event_type"), F.col("size").alias("end_log_pos"), F.coalesce("info", F.lit("")).alias("info"))


@query("SELECT file, c.file_no, row_number() OVER (ORDER BY file_no DESC) AS back FROM file_catalog c")
def h1_sorted_files(spark, sf_dir):
    files = t.file_catalog(t.change_events(spark, sf_dir))
    return files.select("file", "file_no", F.row_number().over(Window.orderBy(F.desc("file_no"))).cast("long").alias("back"))
