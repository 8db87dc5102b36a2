"""The entry points, with the training-data subpackage and without it."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_imports_without_the_subpackage(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    for also in ("there", "gone"):
        if also == "gone":
            (copy / "corpus_pipeline.py").unlink()
        code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert 'pipeline' not in q and len(q) > 200 and len(s) > 200 and set(s) <= set(q)"
        got = subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=120)
        assert got.returncode == 0, got.stderr
