import importlib.util
import os
import subprocess
import sys
from pathlib import Path

CODE = """
from pyspark.sql import SparkSession
from larder.plans.roundtrips import database_scan
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.checkpoint.dir", "file://{0}/shared").getOrCreate()
rows = [(3, "JAPAN", 1), (0, "it's", 1), (24, None, 1)]
spark.createDataFrame(rows, "n_nationkey int, n_name string, n_regionkey int").write.parquet("file://{0}/nation.parquet")
print("GOT", sorted(tuple(r) for r in database_scan(spark, "file://{0}").collect()))
"""


def test_executors_in_other_processes_read_the_database(tmp_path):
    home = tmp_path / "home"  # executors write to the folder work in it
    (home / "work").mkdir(parents=True)
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYTHONPATH": repo, "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", CODE.format(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "GOT [(0, \"it's\"), (3, 'JAPAN'), (24, None)]" in run.stdout, run.stderr[-2000:]
