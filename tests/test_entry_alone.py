from __future__ import annotations

import subprocess
import sys
from pathlib import Path

CODE = r"""
import importlib.abc, re, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("quillspark.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), any(re.match(r"op[0-9]+_|pipeline$", n) for n in e.queries()))
"""


def test_entry_without_the_corpus_operators():
    out = subprocess.run([sys.executable, "-c", CODE], cwd=Path(__file__).parent.parent, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 40 and out[1] == "False"
