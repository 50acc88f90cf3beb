"""The driver's view: a fresh process, another working directory, a plain SparkSession."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
import __spark_entry__ as e
df = e.entry(spark)
print("ROWS", df.count(), df.columns)
print("MV", e.queries()["multivector_docs"](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_in_fresh_process():
    cwd = tempfile.mkdtemp(prefix="vecspark-entry-", dir="/tmp")
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [l for l in out.stdout.splitlines() if l.startswith(("ROWS", "MV"))]
    assert lines[0].startswith("ROWS") and "'qid', 'rk', 'id', 'dist'" in lines[0]
    assert int(lines[1].split()[1]) > 0
