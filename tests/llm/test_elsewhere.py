"""Queries with Python workers run from another folder, where the workers can't import the package."""

import os
import subprocess
import sys

from tests.conftest import DATA, ROOT

SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
for name in sys.argv[2:]:
    print("ROWS", name, entry.queries()[name](spark, {str(DATA)!r}).count())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    names = ["op3_shard", "op7_ngram_lm", "op8_secret_scan", "op9_simhash", "op10_decontaminate", "pipeline"]
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    ran = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path / "shared"), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    rows = dict(line.split()[1:] for line in ran.stdout.splitlines() if line.startswith("ROWS"))
    assert list(rows) == names, ran.stderr[-2000:]
    assert all(rows[n] == "200" for n in names[:-1]) and int(rows["pipeline"]) > 100
