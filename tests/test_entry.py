"""The entry point with and without the optional part, in copies of the repository."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
OPTIONAL = ["quietfield/llm", "tests/llm", "corpus_pipeline.py"]
SAYS = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') and n[2].isdigit() for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [OPTIONAL, OPTIONAL[:2], OPTIONAL[2:]])
def test_imports_without(tmp_path, gone):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "spark-warehouse"))
    if not (at / gone[0]).exists():
        pytest.skip("gone already")
    for name in gone:
        shutil.rmtree(at / name) if (at / name).is_dir() else (at / name).unlink(missing_ok=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAYS], cwd=at, env=env, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert int(out[0]) > 60 and out[1:] == ["0" if "quietfield/llm" in gone else "10", "False"]
