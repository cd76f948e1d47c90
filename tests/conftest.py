import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(shared))
        .config("spark.sql.warehouse.dir", str(shared / "warehouse"))
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def cell(x):
    return repr(x.tolist() if hasattr(x, "tolist") else x)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a query and its SQL give the same rows over sf0.001."""

    def compare(name, make, sql):
        df = make(spark, str(DATA))
        columns = sorted(df.columns)
        mine = sorted(tuple(cell(r[c]) for c in columns) for r in df.collect())
        other = duck.sql(sql)
        assert sorted(other.columns) == columns, name
        at = [other.columns.index(c) for c in columns]
        assert mine == sorted(tuple(cell(r[i]) for i in at) for r in other.fetchall()), name

    return compare
