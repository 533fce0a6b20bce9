"""The driver's contract, with and without the optional package."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as e

ROOT = Path(__file__).resolve().parents[1]


def test_oracles_belong_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_optional_package():
    code = "import sys; sys.modules['foliant.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'greedy_digest' in e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
