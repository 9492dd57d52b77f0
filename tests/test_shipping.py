"""Executors need not have the package, and staged tables go to the folder the session names."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config(
    "spark.checkpoint.dir", {shared!r}).getOrCreate()
import __spark_entry__
for name in ("added_phrases", "predict_table", "training_instances"):
    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
import glob
print(glob.glob({shared!r} + "/redpen-*/*"))
"""


def test_kernels_without_the_package(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    shared = tmp_path / "shared"
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root, shared=str(shared))], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert "sentences-" in done.stdout  # staged in the named folder
    assert not list(shared.glob("redpen-*"))  # and gone with the driver
