"""Every query of the change log against its SQL."""

import pytest

from tidelog.plans import catalog, health, streams, wire  # noqa: F401

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, same):
    same(name, QUERIES[name], SQL[name])


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_strict_grouping_follows_the_step_function(spark):
    from tests.conftest import DATA
    from tidelog.operators.transactions import step
    from tidelog.plans.health import _roled

    got = {r["event_id"]: r["outcome"] for r in QUERIES["g6_strict_transactions"](spark, str(DATA)).collect()}
    open_end, file_no = None, None
    for r in _roled(spark, str(DATA)).orderBy("file_no", "pos").collect():
        if r["file_no"] != file_no:
            open_end, file_no = None, r["file_no"]
        outcome, open_end = step(open_end, r["pos"], r["end_pos"], r["opens"], r["service"], r["txn_length"])
        assert got[r["event_id"]] == outcome
