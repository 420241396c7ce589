"""Operators that cut lineage, in a session without any Spark configuration."""

import os
import subprocess
import sys
from pathlib import Path


CALL = """
import sys
from pyspark.sql import SparkSession
import __spark_entry__

spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
for name in sys.argv[2:]:
    print(name, __spark_entry__.queries()[name](spark, sys.argv[1]).count())
"""


def test_without_checkpoint_folder(data, tmp_path):
    names = ["op5_projected_neighbours", "op6_line_dedup", "op7_orc_tokens", "op10_simhash_near_dedup", "pipeline"]
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    run = subprocess.run([sys.executable, "-c", CALL, data, *names], env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0, run.stderr[-2000:]
    assert [x.split()[0] for x in run.stdout.splitlines()] == names
