"""The entry point without the optional training-data part, or without what that part needs."""

import pathlib
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
CODE = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r}:
            raise ImportError("gone: " + name, name=name)
sys.meta_path.insert(0, Missing())
sys.path.insert(0, {root!r})
import __spark_entry__ as E
names = E.queries()
assert "c2_call_status" in names and set(E.oracle_sql()) <= set(names)
print(sum(n.startswith("op") or n == "pipeline" for n in names), len(names))
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "xxhash", "corpus_pipeline", "callscope.llm"])
def test_the_rest_works_without(name):
    done = subprocess.run([sys.executable, "-c", CODE.format(name=name, root=str(ROOT))], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    optional, every = map(int, done.stdout.split())
    assert optional == 0 and every > 60
