"""Executors have the Python libraries, but no copy of this package."""

import os
import subprocess
import sys

from tests.oracle import DATA

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
RUN = """
import sys
sys.path.insert(0, sys.argv[1])  # the driver only
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def there(batches):
    import importlib.util
    for b in batches:
        yield b.filter([importlib.util.find_spec("quarry") is not None] * b.num_rows)

assert spark.range(8).mapInArrow(there, "id long").count() == 0, "the workers can import the package"
import __spark_entry__ as entry
for name, query in entry.queries().items():
    if name.startswith("op") or name in ("pipeline", "normalize_hash", "hash_embed", "chunk_documents", "html_extract"):
        query(spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


def test_queries_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", RUN, ROOT, DATA], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert got.returncode == 0, got.stderr[-3000:]
    assert got.stdout.count("ran op") == 10 and "ran pipeline" in got.stdout
