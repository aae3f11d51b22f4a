"""The entry module without the operators for training data, or without what they import."""

import subprocess
import sys
from pathlib import Path

from tidemark.plans import catalogue

REPO = str(Path(__file__).resolve().parents[1])


def names(before: str) -> set[str]:
    code = f"import sys; sys.path.insert(0, {REPO!r}); {before}; import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(*e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split())


def test_queries_outlive_a_failed_import():
    own = set(catalogue.queries())
    assert names("sys.modules['zstandard'] = None") == own
    assert names("sys.modules['tidemark.llm'] = None") == own
    assert names("pass") >= own
