"""The entry stands without the optional part, or without a library that only this part needs."""

import subprocess
import sys

import pytest

BLOCK = """
import sys
class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {names!r} or name in {names!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Blocked())
import __spark_entry__ as e
q = e.queries()
assert not [k for k in q if k.startswith("op") and k[2:3].isdigit()] and "pipeline" not in q, sorted(q)
assert set(e.oracle_sql()) <= set(q) and len(q) > 50
"""


@pytest.mark.parametrize("names", [["xxhash"], ["public_tokenizers"], ["siltstone.llm"], ["corpus_pipeline"]])
def test_entry_without(names):
    subprocess.run([sys.executable, "-c", BLOCK.format(names=names)], check=True, timeout=120)
