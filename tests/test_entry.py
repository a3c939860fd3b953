"""The driver's entry without the subpackage of training data: all other queries are there."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql()), 'pipeline' in q, 'agg_leaderboard' in q)"
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env={**os.environ, "PYTHONPATH": str(folder)}, capture_output=True, text=True, check=True).stdout.split()


def test_without_the_subpackage(tmp_path):
    for x in ("quern", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{ROOT}/{x}") else shutil.copy)(f"{ROOT}/{x}", tmp_path / x)
    shutil.rmtree(tmp_path / "quern" / "llm", ignore_errors=True)
    without = names(tmp_path)
    os.makedirs(tmp_path / "quern" / "llm" / "__pycache__")  # what a deleted package may leave
    assert names(tmp_path) == without and int(without[0]) > 200 and without[2:] == ["False", "True"]
