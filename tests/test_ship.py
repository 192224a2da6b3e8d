"""Tasks find the package wherever the driver was started."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
print("rows", e.queries()["m1_one_feature_fits"](spark, "/root/testdata/sf0.001").count())
"""


def test_a_driver_in_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False
    )
    assert "rows 12" in done.stdout, done.stderr[-2000:]
