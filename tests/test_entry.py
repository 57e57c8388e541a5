"""The library without the training-data operators, and the queries with them."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry_points

HERE = Path(__file__).resolve().parent.parent


def test_every_statement_has_its_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_the_rest_stands_without_the_training_data_operators(tmp_path):
    shutil.copytree(HERE / "statuta", tmp_path / "statuta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(HERE / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
