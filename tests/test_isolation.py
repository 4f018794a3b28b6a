"""The library works where the training-data operators are absent."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n.startswith('op') or n == 'pipeline' for n in q))"


@pytest.mark.parametrize("gone", [("voxelloom/llm", "tests/llm"), ("voxelloom/llm", "tests/llm", "corpus_pipeline.py")])
def test_without_llm(tmp_path, gone):
    to = tmp_path / "repo"
    shutil.copytree(ROOT, to, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for x in gone:
        path = to / x
        if path.is_dir():
            shutil.rmtree(path)
        elif path.exists():
            path.unlink()
    out = subprocess.run([sys.executable, "-c", SAY], cwd=to, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(to)})
    assert out.returncode == 0, out.stderr
    n, with_sql, has_llm = out.stdout.split()
    assert int(n) > 100 and int(with_sql) > 100 and has_llm == "False"
