"""A session started elsewhere, without the library on its path."""

import os
import subprocess
import sys

from quayline.llm.common import ROOT
from tests.llm.conftest import DATA

SCRIPT = f"""
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
sys.path.insert(0, {ROOT!r})
import __spark_entry__ as registry
print("ROWS", registry.queries()["op4_line_quality"](spark, {DATA!r}).count())
"""


def test_workers_find_the_library(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 200" in done.stdout, done.stderr[-2000:]
