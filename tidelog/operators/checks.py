"""Is the log well formed: contiguity, gaps, names, catalogues that must agree. Each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOW_32 = 0xFFFFFFFF
MOST_GNO = 2**63 - 2
MIB = 1 << 20


def position_breaks(events: DataFrame, exempt: list[str]) -> DataFrame:
    """Events whose stated next position is not the low 32 bits of position plus length; rotate-like types are exempt."""
    return events.where(((F.col("pos") + F.col("len")).bitwiseAND(F.lit(LOW_32)) != F.col("next_pos")) & ~F.col("event_type").isin(exempt))


def gaps(events: DataFrame) -> DataFrame:
    """Events that begin past the end of the one before in their file, and by how much."""
    order = Window.partitionBy("file_no").orderBy("pos")
    return events.withColumn("gap", F.col("pos") - F.lag("end_pos").over(order)).where("gap > 0")


def sequence_breaks(packets: DataFrame) -> DataFrame:
    """Packets whose one-byte sequence number is not the previous one plus 1, modulo 256."""
    order = Window.partitionBy("file_no").orderBy("pos")
    return packets.withColumn("expected", (F.lag("seq").over(order) + 1) % 256).where("seq <> expected")


def heartbeat_regressions(rows: DataFrame) -> DataFrame:
    """Heartbeats behind the furthest position seen before them in their file."""
    before = Window.partitionBy("file_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("reached", F.max("pos").over(before)).where(F.col("heartbeat") & (F.col("pos") < F.col("reached")))


def is_safe_name(name: Column) -> Column:
    """Base.digits with six digits or more, no path in it."""
    return name.rlike(r"^[^/]+\.[0-9]{6,}$") & ~name.contains("..")


def is_valid_gno(gno: Column, anonymous: Column) -> Column:
    """Numbers run from 1; anonymous transactions have 0."""
    return F.when(anonymous, gno == 0).otherwise(gno.between(1, MOST_GNO))


def is_own_file(name: Column) -> Column:
    """Files of the storage itself that are no logs."""
    return name.isin("log.index", "log.index.tmp", "server-uuid", "server-cert.pem", "server-key.pem")


#: States of reconcile() that refuse the folder, and those whose files may be removed.
REFUSALS, REMNANTS = ("missing", "not_a_name", "other_base", "inside", "several_newer", "no_index"), ("older", "newer")


def reconcile(index: DataFrame, listing: DataFrame, index_existed: bool = True) -> DataFrame:
    """(name, state) of each file in the index or in the folder, but for the storage's own. Both have name,
    the index also ordinal, its lines' order, where it has several bases.

    ok: in both; missing: in the index only. A file of the folder that the index lacks is not_a_name if its name is
    none of a log; older, with the first entry's base and a smaller number; newer, with the last entry's base and a larger
    one, or several_newer if there are more of them; other_base with neither base; else inside. An index without
    entries makes all of them newer, a missing one refuses them (no_index). Remnants may be removed if there is no refusal.
    """
    parsed = lambda df: df.select("name", F.regexp_extract("name", r"^([^/]+)\.([0-9]{6,})$", 1).alias("base"), F.expr(r"try_cast(regexp_extract(name, '^[^/]+\\.([0-9]{6,})$', 1) AS DECIMAL(38, 0))").alias("no"))
    entries = parsed(index)
    ordered = entries.join(index.select("name", "ordinal"), "name") if "ordinal" in index.columns else entries.withColumn("ordinal", F.col("no"))
    # one row: the ends of the index
    ends = ordered.agg(*(f(c, "ordinal").alias(f"{end}_{c}") for end, f in (("first", F.min_by), ("last", F.max_by)) for c in ("base", "no")), F.count(F.lit(1)).alias("entries"))
    both = entries.withColumn("indexed", F.lit(True)).join(parsed(listing.where(~is_own_file(F.col("name")))).select("name", F.col("base").alias("b"), F.col("no").alias("n")), "name", "full_outer")
    empty = F.lit("newer" if index_existed else "no_index")
    extra = (
        F.when((F.col("b") == "") | F.col("n").isNull(), "not_a_name")
        .when(F.col("entries") == 0, empty)
        .when((F.col("b") == F.col("last_base")) & (F.col("n") > F.col("last_no")), "newer")
        .when((F.col("b") == F.col("first_base")) & (F.col("n") < F.col("first_no")), "older")
        .when((F.col("b") != F.col("last_base")) & (F.col("b") != F.col("first_base")), "other_base")
        .otherwise("inside")
    )
    state = F.when(F.col("indexed") & F.col("b").isNull(), "missing").when(F.col("indexed"), "ok").otherwise(extra)
    stated = both.join(F.broadcast(ends), how="cross").select("name", state.alias("state"))
    newer = stated.where("state = 'newer'").agg(F.count(F.lit(1)).alias("_newer"))
    several = (F.col("state") == "newer") & (F.col("_newer") > 1)
    return stated.join(F.broadcast(newer), how="cross").select("name", F.when(several, "several_newer").otherwise(F.col("state")).alias("state"))


def rebuild_checks(files: DataFrame) -> DataFrame:
    """Files in order of (base, number), with what is wrong: gap, in_use_early or shrinking set."""
    order = Window.orderBy("base", "file_no")
    checked = files.withColumns({"_no": F.lag("file_no").over(order), "_held": F.lag("held").over(order), "_last": F.lead("file_no").over(order).isNull()})
    problem = F.when(F.col("file_no") != F.col("_no") + 1, "gap").when(F.col("in_use") & ~F.col("_last"), "in_use_early").when(F.col("held") < F.col("_held"), "not_nested").otherwise("ok")
    return checked.withColumn("problem", F.coalesce(problem, F.lit("ok"))).drop("_no", "_held", "_last")


def duplicate_names(index: DataFrame) -> DataFrame:
    """Names that an index has more than once."""
    return index.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def index_names(text: Column) -> Column:
    """The names of an index file, one a line; null if it does not end in a newline or a name has a path or control character."""
    names = F.split(F.regexp_replace(text, r"\n$", ""), "\n", -1)
    bad = (text != "") & ~text.endswith("\n") | F.exists(names, lambda x: x.rlike(r"[/\x00-\x1f]") | ((x == "") & (text != "")))
    return F.when(text == "", F.array().cast("array<string>")).when(~bad, names)


def purge_mismatches(purged: DataFrame, index: DataFrame) -> DataFrame:
    """Purged names that are not the index's names at the same ordinals."""
    gone, there = purged.select("ordinal", F.col("name").alias("purged")), index.select("ordinal", F.col("name").alias("indexed"))
    return gone.join(there, "ordinal", "left").where(~F.col("purged").eqNullSafe(F.col("indexed")))


def resume_mismatches(stored: DataFrame, resent: DataFrame) -> DataFrame:
    """Events stored and sent again whose bytes differ."""
    s, r = stored.alias("s"), resent.alias("r")
    return s.join(r, (F.col("s.file_no") == F.col("r.file_no")) & (F.col("s.pos") == F.col("r.pos"))).where(F.col("s.body") != F.col("r.body")).select("s.file_no", "s.pos")


def settings_violations(settings: DataFrame) -> DataFrame:
    """(name, rule) for each rule that a settings row breaks. Rules of min_free, window and period apply where there are such columns."""
    rules = {
        "low_below_high": F.col("low") < F.col("high"),
        "reserve_fits": F.col("high") + F.col("reserve") <= F.col("most"),
        "all_positive": (F.col("low") > 0) & (F.col("high") > 0) & (F.col("reserve") > 0) & (F.col("most") > 0),
        "cache_at_least_2_mib": F.col("cache") >= 2 * MIB,
    }
    rules |= {f"{c}_positive": F.col(c) > 0 for c in ("min_free", "window", "period") if c in settings.columns}
    broken = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())))
    return settings.select("name", F.explode(broken).alias("rule"))


def reload_changes(running: DataFrame, loaded: DataFrame) -> DataFrame:
    """E5: (user, change, applied), a row for each difference between the users of two configurations: removed, added and
    password wait for a restart, hosts take effect at once. Both have user, secret and hosts; a user may change twice."""
    ours, theirs = (df.select("user", F.struct("secret", "hosts").alias(side)) for df, side in ((running, "a"), (loaded, "b")))
    a, b = F.col("a"), F.col("b")
    both = a.isNotNull() & b.isNotNull()
    changed = lambda c: both & ~a[c].eqNullSafe(b[c])
    changes = F.array(F.when(b.isNull(), "removed"), F.when(a.isNull(), "added"), F.when(changed("secret"), "password"), F.when(changed("hosts"), "hosts"))
    rows = ours.join(theirs, "user", "full_outer").select("user", F.explode(F.array_compact(changes)).alias("change"))
    return rows.withColumn("applied", F.col("change") == "hosts")


def cache_warning(cache: Column, memory: Column) -> Column:
    """A cache larger than the host's memory."""
    return F.when(cache > memory, F.concat(F.lit("cache of "), cache, F.lit(" bytes exceeds memory of "), memory))


#: Exit codes, and the source's error after which asking again is refused the same way.
SUCCESS, SOURCE_ERROR, STREAM_LOST = 0, 2, 3
HISTORY_GONE = 1236


def stream_end_class(reason: Column, error_code: Column) -> Column:
    """struct(exit_code, reconnect, kind) of why a stream ended.

    Stopped ones (by a signal or by the sink) end well. Lost ones (timeout, connection_closed, end_of_stream) are taken
    up again, as are errors of the source other than HISTORY_GONE. Heartbeat failures and malformed streams end the run, as does a reason that is unknown.
    """
    stopped, lost = reason.isin("stopped", "stopped_by_sink"), reason.isin("timeout", "connection_closed", "end_of_stream")
    error = reason == "source_error"
    return F.struct(
        F.when(stopped, SUCCESS).when(lost, STREAM_LOST).otherwise(SOURCE_ERROR).alias("exit_code"),
        (lost | (error & ~error_code.eqNullSafe(F.lit(HISTORY_GONE)))).alias("reconnect"),
        F.when(stopped, "stopped").when(lost, "stream lost").when(error, "source error").when(reason == "heartbeat_failure", "heartbeat failure").when(reason == "malformed_stream", "malformed stream").otherwise("unrecognized").alias("kind"),
    )


def event_class(event_type: Column, service: list[str], transaction: list[str]) -> Column:
    """Service, transaction (decides skipping) or other."""
    return F.when(event_type.isin(service), "service").when(event_type.isin(transaction), "transaction").otherwise("other")
