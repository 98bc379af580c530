"""The driver's module works whether the training-data operators can be imported or not."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent

BLOCK = """
import sys
class Block:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r} or any(name.startswith(n + ".") for n in {names!r}):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
print(len(e.queries()), sum(q.startswith("op") or q == "pipeline" for q in e.queries()), set(e.oracle_sql()) <= set(e.queries()))
"""


@pytest.mark.parametrize("names", [("glyphsweep.llm",), ("glyphsweep.llm", "corpus_pipeline"), ("xxhash",), ("regex",)], ids=str)
def test_without_the_training_data_operators(names):
    ran = subprocess.run([sys.executable, "-c", BLOCK.format(names=names)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert ran.returncode == 0, ran.stderr
    n, others, covered = ran.stdout.split()
    assert int(n) > 90 and others == "0" and covered == "True" and "left out" in ran.stderr
