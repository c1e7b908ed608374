"""The driver's contract without the optional parts."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from tests.conftest import ROOT


@pytest.mark.parametrize("gone", [["walkrank/llm", "tests/llm"], ["walkrank/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"], []])
def test_entry_without_corpus_operators(tmp_path, gone):
    for name in ("walkrank", "corpus_pipeline.py", "__spark_entry__.py", "bench.py"):
        if (source := os.path.join(ROOT, name)) and os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path)
    for name in gone:
        path = tmp_path / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() or not path.exists() else path.unlink()
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(tmp_path), *(p for p in sys.path if p and os.path.abspath(p) != ROOT)])}
    out = subprocess.run([sys.executable, "-c", "import bench, __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, n_sql = map(int, out.stdout.split())
    assert n >= n_sql > 40


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
