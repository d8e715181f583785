"""Everything but the corpus operators works in a copy without their folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
USE = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession

spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
names = entry.queries()
assert names and not [n for n in names if n == "pipeline" or n.startswith("op1")], sorted(names)
assert set(entry.oracle_sql()) <= set(names)
assert entry.entry(spark).count() > 0
"""


@pytest.mark.parametrize("pipeline", [True, False])
def test_rest_works_without_the_optional_part(tmp_path, pipeline):
    gone = {"llm", ".git", "__pycache__"} | (set() if pipeline else {"corpus_pipeline.py"})
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda _, names: gone & set(names))
    run = subprocess.run([sys.executable, "-c", USE], cwd=copy, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)} | _java(), capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]


def _java():
    import os

    return {k: v for k, v in os.environ.items() if k in ("JAVA_HOME", "PATH", "HOME", "SPARK_LOCAL_IP", "LD_LIBRARY_PATH")}
