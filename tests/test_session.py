"""Checkpoint folder handling in a session where spark.checkpoint.dir is unset
(separate process with an empty Spark configuration folder)."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = r"""
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from rivalry.session import checkpoint_dir, configured_dir
from rivalry.operators.ranking import row_number
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
try:
    checkpoint_dir(spark)
    print("NO-ERROR")
except RuntimeError:
    print("LIBRARY-REFUSES")
df = spark.createDataFrame([(1, 5), (1, 3), (2, 4)], "g int, v int")
rn = row_number(df, ["g"], ["v"])
print("NO-FOLDER", configured_dir(spark) is None and spark.sparkContext.getCheckpointDir() is None)
print("ROWS", sorted((r.g, r.v, r.rn) for r in rn.collect()))
spark.stop()
"""


def test_unset_checkpoint_folder():
    env = dict(os.environ, SPARK_CONF_DIR=tempfile.mkdtemp(prefix="rivalry-noconf-", dir="/tmp"))
    out = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], env=env, capture_output=True, text=True,
                         timeout=300).stdout
    assert "LIBRARY-REFUSES" in out
    assert "NO-FOLDER True" in out
    assert "ROWS [(1, 3, 1), (1, 5, 2), (2, 4, 1)]" in out
