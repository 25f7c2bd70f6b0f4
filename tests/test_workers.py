"""What a cluster needs: code that reaches the workers, and a folder that all of them see."""

import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tableseek.session import shared_dir

JOB = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from tableseek.operators import lineage as L
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
queries = spark.createDataFrame([(0, "d", "SELECT * FROM boats")], "query_id int, db_id string, sql string")
catalog = spark.createDataFrame([("d", "boats")], "db_id string, table_name string")
assert [r["table_name"] for r in L.syntax_tables(queries, catalog).collect()] == ["boats"]
"""


def test_functions_reach_workers_that_cannot_import_the_package(tmp_path):
    job = tmp_path / "job.py"
    job.write_text(JOB.format(repo=str(Path(__file__).resolve().parents[1])))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(job)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_session_without_a_shared_folder_is_refused():
    bare = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(bare)
