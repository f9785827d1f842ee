"""The driver's contract without what is optional."""

import os
import subprocess
import sys

import pytest

from foliospark.queries import QUERIES

HIDING = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == sys.argv[1] or name.startswith(sys.argv[1] + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__
print(*sorted(__spark_entry__.queries()))
"""


@pytest.mark.parametrize("hidden", ["foliospark.llm", "xxhash", "regex"])
def test_core_queries_need_no_optional_module(hidden):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"PYTHONPATH": os.pathsep.join([root, *sys.path])}
    out = subprocess.run([sys.executable, "-c", HIDING, hidden], env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    assert set(out.stdout.split()) == set(QUERIES)
