"""The queries that stay when the corpus operators, or a library of theirs, can't be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
BLOCKED = """
import sys
sys.modules[{name!r}] = None
import __spark_entry__ as entry
names = entry.queries()
assert not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(entry.oracle_sql()) <= set(names)
print(len(names))
"""


@pytest.mark.parametrize("name", ["tidewire.llm", "corpus_pipeline", "zstandard", "ahocorasick", "tokenizers"])
def test_other_queries_are_registered(name):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 130
