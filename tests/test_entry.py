"""The driver contract, run the way a driver runs it: its own plain session,
another working directory, so executor workers must get the package shipped."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false").getOrCreate())
import __spark_entry__ as E
df = E.entry(spark)
print("ENTRY", df.columns, df.count())
print("UDF", E.queries()["mcnemar"](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_and_udf_queries_from_another_directory(tmp_path, small_dir):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ENTRY ['playlist', 'F', 'O', 'P'] 5" in out.stdout, out.stderr[-2000:]
    assert "UDF 1" in out.stdout, out.stderr[-2000:]
