"""Ordered ingest across a restart, with events out of order, repeated and missing."""

from tidelog.operators.transactions import step
from tidelog.streaming import ingest


def test_ingest_resumes_from_its_checkpoint(spark, tmp_path):
    events, at = [], 4
    for k in range(60):
        opens = k % 6 == 0
        events.append((k, 1, at, at + 10, opens, False, 30 if opens else 0))
        at += 10
    write = lambda rows: spark.createDataFrame(rows, ingest.EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = ingest.ordered_events(ingest.read_events(spark, str(tmp_path / "in")))
        ingest.append_to_table(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).drop("batch").collect())

    write([e for e in events if e[0] < 30 and e[0] != 12][::-1])  # backwards, with a hole
    first = run()
    assert [r[1] for r in first] == list(range(12))
    write(events[5:13] + events[30:])  # the hole, some repeats, the rest
    done = run()
    expected, open_end, published = [], None, 4
    for k, f, pos, end, opens, service, length in events:
        outcome, open_end = step(open_end, pos, end, opens, service, length)
        published = end if outcome in ("GroupEnd", "Standalone") else published
        expected.append((f, k, pos, end, outcome, published))
    assert done == expected
