"""Planted cases of rules whose queries read stand-ins."""

from pyspark.sql import functions as F

from tidelog.operators import checks, dump, status
from tidelog.sources import tables


def test_start_decisions(spark):
    # file 3 needs a:[1,5); file 4 needs a:[1,9) and b:[1,3); source b first appears in file 4
    previous = spark.createDataFrame([(3, 1, 1, 5), (4, 1, 1, 9), (4, 2, 1, 3)], "file_no long, source long, start long, end long")
    catalog = spark.createDataFrame([(3,), (4,)], "file_no long")
    requests = [("lacks_a", True, 2, 1, 9), ("part_of_a", True, 1, 1, 4), ("only_a", True, 1, 1, 9), ("old_a", True, 1, 1, 5), ("both", True, 1, 1, 20), ("both", True, 2, 1, 3), ("hole", True, 1, 1, 3), ("hole", True, 1, 4, 20), ("own", True, 1, 1, 20), ("own", True, 7, 1, 2), ("bad", False, None, None, None), ("empty", True, None, None, None)]
    df = spark.createDataFrame(requests, "address string, ok_text boolean, source long, start long, end long")
    got = {r["address"]: (r["decision"], r["start_no"]) for r in dump.start_decision(df, previous, catalog, 7).collect()}
    purged = ("purged", None)
    assert got == {"lacks_a": purged, "part_of_a": purged, "only_a": ("ok", 3), "old_a": ("ok", 3), "both": ("ok", 4), "hole": purged, "own": ("own_uuid", None), "bad": ("bad_set", None), "empty": purged}
    first = catalog.unionByName(spark.createDataFrame([(1,)], "file_no long"))
    got = {r["address"]: r["start_no"] for r in dump.start_decision(df, previous, first, 7).where("decision = 'ok'").collect()}
    assert got == {"lacks_a": 1, "part_of_a": 1, "only_a": 3, "old_a": 3, "both": 4, "hole": 1, "empty": 1}
    none = {r["address"]: r["decision"] for r in dump.start_decision(df, previous, catalog.where("false"), 7).collect()}
    assert none["empty"] == none["both"] == "no_history" and none["bad"] == "bad_set" and none["own"] == "own_uuid"


def test_reconciled_folders(spark):
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "name string")
    state = lambda index, listing, **k: {r["name"]: r["state"] for r in checks.reconcile(names(*index), names(*listing), **k).collect()}
    index = ["log.000003", "log.000004", "log.000006"]
    got = state(index, ["log.000002", "log.000003", "log.000005", "log.000006", "log.000007", "old.000001", "notes", "log.index", "log.1"])
    assert got == {"log.000002": "older", "log.000003": "ok", "log.000004": "missing", "log.000005": "inside", "log.000006": "ok", "log.000007": "newer", "old.000001": "other_base", "notes": "not_a_name", "log.1": "not_a_name"}
    got = state(index, [*index, "log.000007", "log.1000000"])
    assert got["log.000007"] == got["log.1000000"] == "several_newer"
    # the base changes inside the index: each end has its own
    several = spark.createDataFrame([("old.000008", 1), ("log.000001", 2)], "name string, ordinal int")
    listed = names("old.000008", "log.000001", "old.000007", "old.000009", "log.000002")
    got = {r["name"]: r["state"] for r in checks.reconcile(several, listed).collect()}
    assert got == {"old.000008": "ok", "log.000001": "ok", "old.000007": "older", "old.000009": "inside", "log.000002": "newer"}
    assert state([], ["log.000001"]) == {"log.000001": "newer"} and state([], ["log.000001"], index_existed=False) == {"log.000001": "no_index"}


def test_stream_ends(spark):
    cases = {("end_of_stream", None): (3, True), ("timeout", None): (3, True), ("connection_closed", None): (3, True), ("source_error", 1236): (2, False), ("source_error", 1045): (2, True), ("source_error", None): (2, True), ("stopped", None): (0, False), ("stopped_by_sink", None): (0, False), ("malformed_stream", None): (2, False), ("heartbeat_failure", None): (2, False)}
    df = spark.createDataFrame(list(cases), "reason string, code int")
    got = {(r["reason"], r["code"]): (r["x"]["exit_code"], r["x"]["reconnect"]) for r in df.withColumn("x", checks.stream_end_class(F.col("reason"), F.col("code"))).collect()}
    assert got == cases


def test_status_of_subscribers(spark):
    rows = [("dumps_at_end", "f.2", 90, 50, False, True), ("idle", "f.1", 10, 0, True, True), ("waits", "f.2", 10, 50, False, False), ("ahead", "f.2", 95, 50, False, True), ("unknown", "f.9", 5, 0, False, True)]
    df = spark.createDataFrame(rows, "who string, file string, pos long, tsec long, idle boolean, dumping boolean")
    offsets = spark.createDataFrame([("f.1", 0), ("f.2", 100)], "file string, before long")
    published = spark.createDataFrame([("f.2", 90)], "file string, pos long")
    got = {r["who"]: (r["state"], r["behind_bytes"], r["behind_seconds"]) for r in status.replica_status(df, offsets, 60, published).collect()}
    assert got == {"dumps_at_end": ("catching_up", 0, 10), "idle": ("streaming", 180, 0), "waits": ("connected", None, None), "ahead": ("catching_up", None, 10), "unknown": ("catching_up", None, None)}


def test_running_sums_in_parts(spark, monkeypatch):
    rows = [(k, k % 2, 1 + k % 7) for k in range(200)]
    df = spark.createDataFrame(rows, "event_id long, file_no long, len long")
    monkeypatch.setattr(tables, "PART_EVENTS", 9)
    got = {r["event_id"]: r["pos"] for r in tables.running(df, "file_no", "event_id", F.col("len"), "pos").collect()}
    assert got == {k: sum(n for j, f, n in rows if f == k % 2 and j < k) for k, _, _ in rows}
