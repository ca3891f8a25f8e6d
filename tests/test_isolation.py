"""The engine without the training-data operators."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

from .conftest import DATA, ROOT

PROBE = f"""
import sys
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert names and set(sql) <= set(names) and not any(n == "pipeline" or n.startswith("op1") for n in names), sorted(names)
assert not any(m.startswith("graphspark.llm") for m in sys.modules)
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert names["filter_numeric_range"](spark, "{DATA}").count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_operators(tmp_path, pipeline):
    """Neither a left-over pipeline nor its absence keeps the engine from working."""
    copy = tmp_path / "repo"
    gone = [".git", "llm", "__pycache__", *([] if pipeline else ["corpus_pipeline.py"])]
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(*gone))
    done = subprocess.run([sys.executable, "-c", PROBE], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_scratch_needs_a_shared_folder():
    from graphspark import storage

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        conf, sparkContext = {}, Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.scratch(Session(), "x")
