"""The driver's contract without a session."""

import subprocess
import sys
from pathlib import Path


def test_queries_are_listed_without_a_session():
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"], cwd=Path(__file__).parents[1], capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
