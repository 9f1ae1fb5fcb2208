"""The entry point without the training-data subpackage, or without a library that it needs."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["waymark.llm", "public_tokenizers", "corpus_pipeline"])
def test_entry_without(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as entry
from checks import QUERIES
own = {{n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}}
assert own == set(QUERIES)
assert ("pipeline" in entry.queries()) == ({missing!r} == "public_tokenizers")
assert set(entry.oracle_sql()) <= set(entry.queries())
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env={**os.environ, "PYTHONPATH": str(ROOT)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert "left out" in done.stderr
