"""Parsers and decoders on cases with known results."""

import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import decode, parse
from tidelog.operators import checks, intervals, retention
from tidelog.operators.transactions import step


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


@pytest.mark.parametrize(("text", "size"), [("0", 0), ("5", 5), ("2k", 2048), ("3G", 3 << 30), ("15E", 15 << 60), ("16E", None), ("", None), ("-1", None), ("1KB", None), ("18446744073709551615", 2**64 - 1), ("18446744073709551616", None), (None, None)])
def test_byte_size(spark, text, size):
    got = one(spark, text, parse.byte_size)
    assert (None if got is None else int(got)) == size


@pytest.mark.parametrize(("text", "seconds"), [("10s", 10), ("2m", 120), ("1h", 3600), ("3d", 259200), ("0s", None), ("5", None), ("1w", None), ("", None)])
def test_duration(spark, text, seconds):
    assert one(spark, text, parse.duration_seconds) == seconds


@pytest.mark.parametrize(("text", "micros"), [("0", 0), ("200us", 200), ("5ms", 5000), ("5s", None), ("7", None)])
def test_delay(spark, text, micros):
    assert one(spark, text, parse.delay_microseconds) == micros


@pytest.mark.parametrize(("text", "number"), [("10.0.0.1", 10 << 24 | 1), ("010.0.0.1", None), ("1.2.3", None), ("256.1.1.1", None), ("255.255.255.255", 2**32 - 1)])
def test_address(spark, text, number):
    assert one(spark, text, parse.ipv4_number) == number


@pytest.mark.parametrize(("text", "rows"), [("u:1-3:5", [(1, 4), (5, 6)]), ("u", []), ("u:0", None), ("u:3-2", None), ("u:x", None), ("u:7", [(7, 8)])])
def test_set_text(spark, text, rows):
    got = one(spark, text, parse.set_intervals)
    assert (None if got is None else [tuple(r) for r in got]) == rows


@pytest.mark.parametrize(("text", "names"), [("", []), ("a.000001\n", ["a.000001"]), ("a.000001", None), ("a/b.000001\n", None), ("a\n\nb\n", None)])
def test_index_names(spark, text, names):
    assert one(spark, text, checks.index_names) == names


@pytest.mark.parametrize(("name", "safe"), [("log.000001", True), ("log.00001", False), ("../log.000001", False), ("a/b.000001", False), ("log.1000000", True)])
def test_safe_names(spark, name, safe):
    assert one(spark, name, checks.is_safe_name) is safe


@given(st.integers(0, 2**64 - 1))
@settings(max_examples=200)
def test_numbers_round_trip(value):
    assert decode.Reader(decode.packed_bytes(value)).packed() == value
    assert decode.Reader(decode.varint_bytes(value)).varint() == value


def test_null_length():
    assert decode.Reader(decode.packed_bytes(None)).packed() is None
    with pytest.raises(ValueError, match="length"):
        decode.Reader(b"\xff").packed()
    with pytest.raises(ValueError, match="early"):
        decode.Reader(b"\xfc\x01").packed()


@given(st.dictionaries(st.binary(min_size=16, max_size=16), st.lists(st.integers(1, 2**40), min_size=1, max_size=6, unique=True)))
@settings(max_examples=100)
def test_set_codec_round_trip(sets):
    apart = {u: [(2 * x, 2 * x + 1) for x in sorted(own)] for u, own in sets.items()}
    rows = decode.set_rows(decode.set_bytes(list(apart.items())))
    assert rows == [(u, a, b) for u, own in sorted(apart.items()) for a, b in own]


def test_set_codec_refuses_adjacent_intervals_and_leftovers():
    with pytest.raises(ValueError, match="order"):
        decode.set_rows(decode.set_bytes([(b"u" * 16, [(1, 3), (3, 5)])]))
    with pytest.raises(ValueError, match="left over"):
        decode.set_rows(decode.set_bytes([]) + b"x")


def test_transaction_body_with_and_without_length():
    body = b"\x01" + b"u" * 16 + struct.pack("<Q", 7)
    assert decode.transaction_fields(body) == (b"u" * 16, 7, None)
    timed = body + b"\x02" + bytes(16) + (5).to_bytes(7, "little") + decode.packed_bytes(337)
    assert decode.transaction_fields(timed) == (b"u" * 16, 7, 337)
    twice = body + b"\x02" + bytes(16) + (1 << 55 | 5).to_bytes(7, "little") + bytes(7) + decode.packed_bytes(9)
    assert decode.transaction_fields(twice) == (b"u" * 16, 7, 9)


def test_log_files_are_walked_to_the_last_whole_event(spark, tmp_path):
    events = [struct.pack("<IBIIIH", 100 + k, 15, 9, 19 + k, 0, 1) + bytes(k) for k in range(4)]
    (tmp_path / "a").write_bytes(decode.MAGIC + b"".join(events) + events[0][:10])
    (tmp_path / "b").write_bytes(b"none")
    rows = decode.scan_log_bytes(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("pos").collect()
    assert [(r["pos"], r["timestamp"], r["event_length"]) for r in rows] == [(4, 100, 19), (23, 101, 20), (43, 102, 21), (64, 103, 22)]


def test_step_outcomes():
    assert step(None, 4, 10, True, False, 20) == ("GroupStart", 24)
    assert step(24, 10, 20, False, False, 0) == ("InGroup", 24)
    assert step(24, 20, 24, False, False, 0) == ("GroupEnd", None)
    assert step(24, 20, 25, False, False, 0) == ("Malformed", 24)
    assert step(24, 10, 20, False, True, 0) == ("Malformed", 24)
    assert step(None, 4, 10, False, True, 0) == ("Standalone", None)


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 30), st.integers(1, 6)), max_size=40))
@settings(max_examples=15, deadline=None)
def test_merged_intervals_equal_the_set_of_their_numbers(spark, rows):
    df = spark.createDataFrame([(k, a, a + n) for k, a, n in rows], "k int, start long, end long")
    got = sorted(tuple(r) for r in intervals.merge_intervals(df, ["k"]).select("k", "start", "end").collect())
    assert {(k, x) for k, a, b in got for x in range(a, b)} == {(k, x) for k, a, n in rows for x in range(a, a + n)}
    assert all(x[0] != y[0] or x[2] < y[1] for x, y in zip(got, got[1:]))


def test_subset_of_empty_and_by_one_interval(spark):
    make = lambda rows: spark.createDataFrame(rows, "k int, start long, end long")
    assert intervals.is_subset(make([]), make([]), ["k"])
    assert intervals.is_subset(make([(1, 2, 4)]), make([(1, 1, 5)]), ["k"])
    assert not intervals.is_subset(make([(1, 2, 4)]), make([(2, 1, 5)]), ["k"])


def test_purge_stops_at_the_first_file_that_stays(spark):
    rows = [(n, 100, 100 * n, n == 5, True, 1 if n == 3 else 0) for n in range(1, 6)]
    catalog = spark.createDataFrame(rows, "file_no long, size long, created_at long, in_use boolean, on_disk boolean, pins int")
    kept = {r["file_no"]: r["removed"] for r in retention.purge(catalog, cutoff=450, high=10**9, low=0, available=10, min_free=0).collect()}
    assert kept == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_tagged_bodies_refuse_disorder_and_missing_fields():
    whole = decode.tagged_bytes(b"u" * 16, 5, "tag", 337)
    assert decode.tagged_fields(whole) == (b"u" * 16, 5, "tag", 337)
    assert decode.tagged_fields(decode.tagged_bytes(b"\xff" * 16, 2**62, "t", None)) == (b"\xff" * 16, 2**62, "t", None)
    for bad in (whole[:20], b"", varied(whole, 0, 4), decode.tagged_bytes(b"u" * 16, 5, "x" * 33, 1)):
        with pytest.raises(ValueError):
            decode.tagged_fields(bad)


def varied(data, at, value):
    return data[:at] + bytes([value]) + data[at + 1 :]


def test_heartbeats_step_over_unknown_fields():
    body = decode.heartbeat_bytes("log.000001", 2**33)
    assert decode.heartbeat_fields(b"\x09\x02ab" + body) == ("log.000001", 2**33)
    with pytest.raises(ValueError):
        decode.heartbeat_fields(body[:-1])
