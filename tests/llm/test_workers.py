"""What runs in Python workers must not need the package there."""

from __future__ import annotations

import os
import subprocess
import sys

from tests.llm.test_queries import sf_dir  # noqa: F401

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").getOrCreate()


def without(batches):
    import importlib.util

    assert importlib.util.find_spec("tracewell") is None
    yield from batches


assert spark.range(3).mapInArrow(without, "id long").count() == 3
from tracewell.llm import queries
for name in sorted(queries.QUERIES):
    try:
        print("ROWS", name, queries.QUERIES[name](spark, {tables!r}).count())
    except Exception as e:
        print("FAILED", name, str(e)[:600])
"""


def test_queries_run_where_workers_cannot_import_the_package(sf_dir, tmp_path):  # noqa: F811
    """Spark's own workers start in another folder, without a path to the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=os.getcwd(), tables=sf_dir)
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "FAILED" not in done.stdout and done.stdout.count("ROWS") == 13, done.stdout[-3000:] + done.stderr[-2000:]
