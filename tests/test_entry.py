"""The entry stands without the parts that may be taken out."""

import os
import shutil
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
TRY = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("gone", [["warraq/llm", "tests/llm"], ["warraq/llm", "tests/llm", "corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, gone):
    shutil.copytree(HERE, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", *(os.path.basename(g) for g in gone)))
    env = os.environ | {"PYTHONPATH": str(tmp_path / "r")}
    said = subprocess.run([sys.executable, "-c", TRY], cwd=tmp_path / "r", env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    n, own, known = said.stdout.split()[-3:]
    assert int(n) > 150 and own == "0" and known == "True"
