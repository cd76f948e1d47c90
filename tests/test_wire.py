"""Bytes and rules with known results: trailers, tags, file headers, appends, resent events, answers, addresses."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidelog.functions import decode, parse
from tidelog.operators import append, intervals, statements
from tidelog.plans import wire
from tidelog.streaming import ingest

U, V = "12345678-1234-1234-1234-1234567890ab", "02345678-1234-1234-1234-1234567890ab"
RAW = bytes.fromhex(U.replace("-", ""))


def test_trailers_are_taken_off():
    body = b"\x01" + RAW + struct.pack("<Q", 7) + b"\x02" + bytes(16) + (5).to_bytes(7, "little")
    assert decode.transaction_fields(body + b"\xaa\xbb\xcc\xdd", 4) == (RAW, 7, None)
    assert decode.transaction_fields(body + b"\x10\xaa\xbb\xcc\xdd", 4) == (RAW, 7, 16)
    assert decode.transaction_fields(body[:25] + b"\x00" + bytes(9)) == (RAW, 7, None)  # another clock
    for bad in (b"abc", body[:20] + bytes(4), body[:30] + bytes(4)):
        with pytest.raises(ValueError):
            decode.transaction_fields(bad, 4)
    assert decode.tagged_fields(decode.tagged_bytes(RAW, 5, "tag", 337) + b"\xff" * 4, 4) == (RAW, 5, "tag", 337)
    assert decode.heartbeat_fields(decode.heartbeat_bytes("a.000001", 9) + b"\x00" * 4, 4) == ("a.000001", 9)
    with pytest.raises(ValueError):
        decode.heartbeat_fields(b"\x00\x00\x00", 4)


def test_rotates_and_names_with_trailers(spark):
    rows = [(1, struct.pack("<Q", 4) + b"log.000002" + b"CRC!"), (2, b"short"), (3, None)]
    df = spark.createDataFrame(rows, "k int, b binary")
    got = {r["k"]: (r["position"], r["name"], r["beat"]) for r in df.select("k", *decode.rotate_fields(F.col("b"), 4), decode.heartbeat_name(F.col("b"), 4).alias("beat")).collect()}
    assert got[1][:2] == (4, "log.000002") and got[2] == (None, None, "s") and got[3] == (None, None, None)
    assert spark.createDataFrame([(b"ab",)], "b binary").select(decode.heartbeat_name(F.col("b"), 4)).first()[0] == ""


#: A set in the tagged form: the form, two sources, the form again; a source without a tag and one with the tag "abc".
TAGGED = bytes.fromhex("01 02 00 00 00 00 00 01".replace(" ", "")) + RAW + b"\x00" + struct.pack("<QQQ", 1, 1, 4) + RAW + b"\x06abc" + struct.pack("<QQQQQ", 2, 1, 2, 5, 9)


def test_tagged_sets(spark):
    rows = [(RAW, "", 1, 4), (RAW, "abc", 1, 2), (RAW, "abc", 5, 9)]
    assert decode.tagged_set_rows(TAGGED) == rows
    df = spark.createDataFrame([(1, *r) for r in rows], "k int, uuid binary, tag string, start long, end long")
    assert bytes(decode.encoded_sets(df, ["k"]).first()["encoded"]) == TAGGED
    assert decode.set_rows(bytes(decode.encoded_sets(df, ["k"], tagged=False).first()["encoded"])) == [(RAW, 1, 4)]
    with pytest.raises(ValueError, match="tag"):
        decode.set_rows(TAGGED)
    long_tag, digit = TAGGED.replace(b"\x06abc", b"\x07abc"), TAGGED.replace(b"abc", b"1bc")
    for bad in (long_tag, digit, TAGGED[:-1], TAGGED + b"x", b"\x02" + TAGGED[1:7] + b"\x02" + TAGGED[8:], b""):
        with pytest.raises(ValueError):
            decode.tagged_set_rows(bad)
    sets = spark.createDataFrame([(1, TAGGED), (2, b"?"), (3, bytes(8))], "k int, b binary")
    got = sorted((r["k"], r["tag"], r["start"], r["end"]) for r in decode.decode_sets(sets, "k", "b").na.fill("?", ["tag"]).na.fill(-1).collect())
    assert got == [(1, "", 1, 4), (1, "abc", 1, 2), (1, "abc", 5, 9), (2, "?", -1, -1)]


def test_large_sets_are_written_in_one_pass(spark):
    """A set takes time in proportion to its entries: 100,000 sources, a third with a tag, some with two intervals."""
    k = F.col("id")
    rows = spark.range(100_000).select(F.lit(1).alias("k"), F.unhex(F.md5(k.cast("string").cast("binary"))).alias("uuid"), F.when(k % 3 == 0, "abc").otherwise("").alias("tag"), F.explode(F.when(k % 5 == 0, F.array(F.lit(1), F.lit(7))).otherwise(F.array(F.lit(3))).cast("array<long>")).alias("start")).withColumn("end", F.col("start") + 2)
    sets = decode.encoded_sets(rows, ["k"])
    got = decode.decode_sets(sets, "k", "encoded")
    assert got.count() == 120_000 and got.exceptAll(rows).isEmpty()
    assert " aggregate(" not in sets._jdf.queryExecution().analyzed().toString()  # no bytes that grow entry by entry


def test_texts_of_sets(spark):
    good = {
        "": [],
        ",, ,": [],
        U: [],
        f"{U.upper()}:1-3:5": [(U, "", 1, 4), (U, "", 5, 6)],
        f"{U}:1:tAg:5:7-9:x:1, \n{V}:04": [(U, "", 1, 2), (U, "tag", 5, 6), (U, "tag", 7, 10), (U, "x", 1, 2), (V, "", 4, 5)],
        f"{U}:9223372036854775806": [(U, "", 2**63 - 2, 2**63 - 1)],
    }
    bad = [f"{U}:0", f"{U}:3-2", f" {U}", f"{U}:1 ,{V}", f"{U}:", f"{U}:{2**63 - 1}", f"{U}:1\n", f"{U}:{'9' * 50}", f"{U}:{'x' * 33}", f"{U}:1-", "u:1", None]
    df = spark.createDataFrame([(x,) for x in [*good, *bad]], "t string")
    got = {r["t"]: r["x"] for r in df.select("t", parse.set_rows(F.col("t")).alias("x")).collect()}
    assert {t: [tuple(r) for r in got[t]] for t in good} == good
    assert all(got[t] is None for t in bad)
    rows = spark.createDataFrame([(1, *r) for t in good for r in good[t] if r[2] != 1 or t.startswith(U.upper())], "k int, uuid string, tag string, start long, end long")
    assert intervals.set_texts(rows, ["k"]).first()["text"] == f"{V}:4,\n{U}:1-3:5:9223372036854775806:tag:5:7-9"


def test_addresses(spark):
    digits = {"::1": "0" * 31 + "1", "::": "0" * 32, "1::": "0001" + "0" * 28, "1:2:3:4:5:6:7:8": "00010002000300040005000600070008", "1:2:3:4:5:6:7::": "00010002000300040005000600070000", "::ffff:10.0.0.1": "0" * 20 + "ffff0a000001", "10.0.0.1": "0a000001"}
    bad = ["1::2::3", "fe80::1%eth0", "12345::", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7:8::", "10.0.0.01", ":1", "1:", ":::", "::1.2.3", "", None]
    df = spark.createDataFrame([(x,) for x in [*digits, *bad]], "a string")
    assert {r["a"]: r["d"] for r in df.select("a", parse.address_hex(F.col("a")).alias("d")).collect()} == digits | dict.fromkeys(bad)
    cases = {("10.0.0.1", "10.0.0.0/8"): True, ("10.0.0.1", "10.0.0.1"): True, ("10.0.0.1", "0.0.0.0/0"): True, ("::1", "::/0"): True, ("::1", "0.0.0.0/0"): False, ("fe80::5", "fe80::/10"): True, ("ff80::5", "fe80::/10"): False}
    cases |= dict.fromkeys([("10.0.0.1", "10.0.0.1/8"), ("10.0.0.1", "10.0.0.0/33"), ("::1", "::/129"), ("1.1.1.1", "1.1.1.1/"), ("x", "::/0"), (None, "::/0")])
    df = spark.createDataFrame(list(cases), "a string, n string")
    assert {(r["a"], r["n"]): r["i"] for r in df.select("a", "n", parse.in_address_range(F.col("a"), F.col("n")).alias("i")).collect()} == cases


def test_addresses_are_parsed_once_and_by_all_tasks(spark):
    digits = ["", "0", "f", "0a000001", "00010002000300040005000600070008", "20010db8" + "f" * 24, "abc", "123456789", None]
    df = spark.createDataFrame([(x,) for x in digits], "d string")
    assert [r[0] for r in df.select(parse.address_bits(F.col("d"))).collect()] == [x and "".join(f"{int(c, 16):04b}" for c in x) for x in digits]
    mentions = lambda c: spark.createDataFrame([], "a string, n string").select(c)._jdf.queryExecution().analyzed().toString().count("split_part(n#")
    assert mentions(parse.in_address_range(F.col("a"), F.col("n"))) == mentions(parse.address_range(F.col("n"))) > 0
    assert wire.d8_ipv6_ranges(spark, str(DATA)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def log_file(version=b"8.0.1", mark=1, flags=1, sets=TAGGED, kinds=(15, 35)):
    body = struct.pack("<H", 4) + version.ljust(50, b"\0") + struct.pack("<IB", 9, 19) + bytes(40) + bytes([mark]) + bytes(4)
    one = lambda kind, b, f: struct.pack("<IBIIIH", 100, kind, 77, 19 + len(b), 0, f) + b
    trailer = b"" if version < b"5.6.1" or mark != 1 else b"\xaa" * 4
    return decode.MAGIC + one(kinds[0], body, flags) + one(kinds[1], sets + trailer, 0)


def test_headers_of_files(spark, tmp_path):
    files = {"log.000001": log_file(), "log.000002": log_file(b"5.5.62", 0, 0, bytes(8)), "log.000003": log_file(mark=0, flags=0), "log.000004": log_file(mark=9, sets=bytes(8))}
    bad = {"log.000005": b"none", "log.000006": log_file()[:-1], "log.000007": log_file(kinds=(15, 2)), "log.000008": log_file(kinds=(34, 35)), "log.000009": log_file(sets=bytes(7)), "log.index": log_file(), "log.000010": b"\xfe", "log.000011": log_file()[:20]}
    for name, content in (files | bad).items():
        (tmp_path / name).write_bytes(content)
    got = {r["name"]: r for r in decode.file_headers(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    fields = ["created_at", "server_id", "in_use", "server_version", "checksum", "header_length"]
    plain = len(files["log.000002"])
    assert [tuple(got[n][f] for f in fields) for n in files] == [(100, 77, True, "8.0.1", "CRC32", len(files["log.000001"])), (100, 77, False, "5.5.62", "UNDEF", plain), (100, 77, False, "8.0.1", "OFF", len(files["log.000003"])), (100, 77, True, "8.0.1", "UNKNOWN(9)", plain)]
    assert bytes(got["log.000001"]["previous"]) == bytes(got["log.000003"]["previous"]) == TAGGED
    assert set(got) == set(files) | set(bad) and all((got[n]["error"] is None) == (n in files) for n in got)


def test_a_large_set_in_a_file_is_read_in_parts(spark, tmp_path):
    count = 2 * decode.BATCH_ROWS + 7
    sets = decode.set_bytes([(k.to_bytes(16, "big"), [(1, k + 2)]) for k in range(count)])
    (tmp_path / "log.000001").write_bytes(log_file(mark=0, sets=sets))
    rows = decode.decode_sets(decode.file_headers(spark.read.format("binaryFile").load(str(tmp_path))), "name", "previous")
    assert rows.agg(F.count("uuid"), F.sum("end")).first()[:] == (count, sum(range(2, count + 2)))
    assert rows.select("uuid", "tag", "start").distinct().count() == count
    files = spark.createDataFrame([("a", bytes(8)), ("b", sets), ("c", b"?"), ("d", TAGGED)], "name string, previous binary").coalesce(1)
    got = {r["name"]: r["n"] for r in decode.decode_sets(files, "name", "previous").groupBy("name").agg(F.count("uuid").alias("n")).collect()}
    assert got == {"b": count, "c": 0, "d": 3}


def test_append_faults(spark):
    whole = [("announce", 1, 0, 0), ("description", 1, 4, 80), ("previous", 1, 80, 100), ("event", 1, 100, 150), ("event", 1, 150, 160), ("close", 1, 160, 180), ("announce", 2, 0, 0), ("description", 2, 4, 90), ("previous", 2, 90, 99)]

    def faults(rows, opened=()):
        df = spark.createDataFrame([("s", k, *r, k in opened) for k, r in enumerate(rows)], "stream string, ord long, kind string, file_no long, pos long, end_pos long, open_after boolean")
        found = append.append_faults(df)
        left = append.appended(df, found).count()
        rows = [(r["ord"], r["fault"]) for r in found.orderBy("ord").collect()]
        assert left == (rows[0][0] if rows else len(df.collect()))
        return rows

    swap = lambda k, r: [*whole[:k], r, *whole[k + 1 :]]
    assert faults(whole) == [] and faults(whole, {3}) == []
    assert faults(whole[1:])[0] == (0, "expected_announcement")
    assert faults(swap(1, ("description", 1, 5, 80))) == [(1, "expected_description")]
    assert faults(swap(2, ("event", 1, 80, 100))) == [(2, "expected_previous_sets")]
    assert faults(swap(2, ("previous", 1, 81, 100))) == [(2, "expected_previous_sets")]
    assert faults(swap(4, ("event", 1, 151, 160))) == [(4, "gap")]
    assert faults(swap(4, ("event", 1, 149, 160))) == [(4, "behind")]
    assert faults(swap(4, ("description", 1, 4, 160))) == [(4, "unexpected_header"), (5, "expected_previous_sets")]
    assert faults(swap(6, ("announce", 1, 0, 0))) == [(6, "exists")]
    assert faults(swap(6, ("announce", 0, 0, 0))) == [(6, "lower_number")]
    assert faults([*whole[:5], ("announce", 1, 0, 0)]) == [(5, "still_open")]
    assert faults([*whole[:5], ("announce", 2, 0, 0)]) == []
    assert faults(whole, {4}) == [(5, "interrupts_transaction")]
    assert faults(whole[:6] + [("event", 1, 180, 190)]) == [(6, "expected_announcement")]


def test_resent_events(spark):
    schema = "file_no long, pos long, end_pos long, body string"
    stored = spark.createDataFrame([(1, 4, 10, "a"), (1, 10, 20, None), (1, 20, 30, "c")], schema)
    again = spark.createDataFrame([(1, 4, 10, "a"), (1, 10, 20, None), (1, 20, 30, "x"), (1, 11, 20, "b"), (1, 30, 40, "new"), (2, 4, 9, "other file")], schema)
    got = {(r["pos"], r["fault"]) for r in append.resent_faults(again, stored, ["end_pos", "body"]).collect()}
    assert got == {(20, "differs"), (11, "no_event_there")}


def test_answers(spark):
    variables = spark.createDataFrame([("server_id", "7"), ("gtid_purged", ""), ("version", "8"), ("other", "x")], "name string, value string")
    cases = {
        "select @@server_id": (["@@server_id"], ["7"], None),
        "SELECT @@Session.Server_Id , version() limit 1 ;": (["@@Session.Server_Id", "version()"], ["7", "8"], None),
        "SELECT @a, @B, @c": (["@a", "@B", "@c"], ["1", "2", None], None),
        "SELECT UNIX_TIMESTAMP()": (["UNIX_TIMESTAMP()"], ["99"], None),
        "SELECT @@gtid_purged": (["@@gtid_purged"], [""], None),
        "SELECT @@other": (None, None, 1193),
        "SELECT @@foo.server_id": (None, None, 1193),
        "SELECT @@x, 1": (None, None, 1193),
        "SELECT 1, @@x": (None, None, 1235),
        "SELECT @@": (None, None, 1235),
        "SELECT @@server_id,": (None, None, 1235),
        "SELECT @@server_id FROM t": (None, None, 1235),
        "DELETE FROM t": (None, None, 1235),
        None: (None, None, 1235),
    }
    df = spark.createDataFrame([(x, {"a": "1", "b": "2"}) for x in cases], "sql string, session map<string,string>")
    got = {r["sql"]: (r["names"], r["values"], r["error"]) for r in statements.select_answers(df, variables, F.lit(99)).collect()}
    assert got == cases
    names = spark.createDataFrame([("OFF",), ("",), (None,), ("CRC32",)], "a string")
    assert [r[0] for r in names.select(statements.checksum_variable(F.col("a"))).collect()] == ["NONE", "CRC32", "CRC32", "CRC32"]


def test_long_values_meet_only_those_that_ask(spark):
    text = "1:1-5," * 1000
    variables = spark.createDataFrame([("gtid_executed", text), ("version", "8"), ("server_uuid", None)], "name string, value string")
    cases = {
        "SELECT @@gtid_executed, version(), @@Global.GTID_executed": ([text, "8", text], None),
        "SELECT @@server_uuid": ([None], None),
        "SELECT @@version, @a": (["8", "1"], None),
        "SELECT @@gtid_executed, @@x": (None, 1193),
        "SELECT 1, @@gtid_executed": (None, 1235),
        None: (None, 1235),
    }
    df = spark.createDataFrame([(x, {"a": "1"}) for x in cases], "sql string, session map<string,string>")
    out = statements.select_answers(df, variables, F.lit(99))
    assert {r["sql"]: (r["values"], r["error"]) for r in out.collect()} == cases and out.columns == ["sql", "session", "error", "names", "values"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    crossed, outer = plan.index("Join Cross"), plan.index("Join LeftOuter")
    assert outer < crossed and "> 256)" in plan  # the map that all rows get has no long value


def test_answers_are_written_with_one_set_a_file(spark, tmp_path):
    """700 statements ask for a set of 1,039,983 bytes; in one file their times would outgrow the writer's dictionary and bring 700 copies."""
    first, users = 10**18, 47_272
    k = F.col("id")
    event_id = F.when(k < 700, 7 * k + 6).otherwise(7 * k)
    columns = {"event_id": event_id, "ts": F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id)"), "user_id": first + k, "event_type": F.lit("view"), "value": F.lit(0.0), "props": F.lit("{}")}
    spark.range(users).select(*(c.alias(n) for n, c in columns.items())).write.parquet(str(tmp_path / "events.parquet"))
    text = ",".join(f"{first + i}:1" for i in range(users))
    wire.k2_select_answers(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    asked = out.where("event_id % 7 = 6").select("event_id", F.md5(F.col("values")[0].cast("binary")), F.col("values")[1].cast("long"), "error")
    assert sorted(map(tuple, asked.collect())) == [(7 * i + 6, hashlib.md5(text.encode()).hexdigest(), 1704067200 + i, None) for i in range(700)]
    assert out.count() == users and out.where("event_id % 7 = 0 AND values = array('7', 'ON')").count() == users - 700
    files = [p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")]
    assert sum(files) < len(files) * len(text) and len(files) < 100
    assert statements.answer_parts(700, len(text) + 1) == 3  # 280 of 16 bytes beside the set
    assert statements.answer_parts(857_142, 978_890) == 210 and statements.answer_parts(0, 0) == 0
    assert statements.answer_parts(700, 1 << 20) == 0  # no dictionary holds it


def test_waiting_events_are_listed(spark, tmp_path):
    rows = [(k, k % 3, 4 + 10 * (k // 3), 14 + 10 * (k // 3), False, False, 0) for k in range(30) if k not in (7, 20)]
    spark.createDataFrame(rows, ingest.EVENT_SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = ingest.ordered_events(ingest.read_events(spark, str(tmp_path / "in")))
    ingest.append_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["file_no"]: (r["appended"], r["first_waiting"], r["waiting"]) for r in ingest.waiting(spark, str(tmp_path / "state")).collect()}
    assert got == {1: (24, 34, 7), 2: (64, 74, 3)}
