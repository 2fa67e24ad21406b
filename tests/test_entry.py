"""The entry point works without the training-data operators and without a library that they need."""

import subprocess
import sys
from pathlib import Path

import pytest

from matchpulse.plans.queries import REGISTRY

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["zstandard", "sentencepiece", "matchpulse.llm"])
def test_core_queries_are_there_without(missing):
    code = f"""
import sys, warnings
sys.modules[{missing!r}] = None  # importing it fails
warnings.simplefilter("ignore")
import __spark_entry__ as entry
assert entry.LLM_MISSING
print(len(entry.queries()), len(entry.oracle_sql()))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(REGISTRY))] * 2
