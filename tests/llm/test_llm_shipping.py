"""The corpus queries run on executors that do not have the package, and stage in the named folder."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config(
    "spark.checkpoint.dir", {shared!r}).getOrCreate()
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
"""


def test_without_the_package(tmp_path):
    root = str(Path(__file__).resolve().parent.parent.parent)
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root, shared=str(tmp_path / "shared"))], cwd=tmp_path, capture_output=True, text=True, timeout=600
    )
    assert done.returncode == 0, done.stderr[-3000:]
