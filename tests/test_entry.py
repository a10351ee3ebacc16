"""The driver reaches every operator, with the training-data subpackage and without it."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_entry_returns_rows(spark):
    assert e.entry(spark).count() > 0


def test_sql_only_for_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_stands_alone():
    code = "import sys; sys.modules['foliospark.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k[:1] == 'p' and k[1:2].isdigit() for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=60)
