"""What the driver calls, with the training-data subpackage and without it."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]

CALLS = """
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names and len(names) > 60
assert not any(n.startswith("op") and n[2:3].isdigit() or n == "pipeline" for n in names), names
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert entry.entry(spark).count() > 0
spark.stop()
"""


@pytest.mark.parametrize("pipeline_too", [True, False])
def test_without_the_subpackage(tmp_path, pipeline_too):
    if not (pipeline_too or (ROOT / "corpus_pipeline.py").exists()):
        pytest.skip("the pipeline's file is gone here")
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *["corpus_pipeline.py"] * pipeline_too))
    assert not (copy / "topicloom" / "llm").exists() and (copy / "corpus_pipeline.py").exists() != pipeline_too
    done = subprocess.run([sys.executable, "-c", CALLS], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_nothing_else_imports_the_subpackage():
    for path in [*(ROOT / "topicloom").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != "test_entry.py":
            assert "llm" not in path.read_text(), path
