"""Executors that can't import the package get it from the driver."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("ROWS", e.queries()["op8_simhash_groups"](spark, "/root/testdata/sf0.001").count())
"""


def test_from_elsewhere(tmp_path, monkeypatch):
    monkeypatch.delenv("PYTHONPATH", raising=False)
    root = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "ROWS 200" in out.stdout, out.stderr[-2000:]
