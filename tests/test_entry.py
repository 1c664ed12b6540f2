"""The contract module stands without the training-data subpackage and its third-party modules."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked!r} or name in {blocked!r}:
            raise ImportError(name + " is not there")
sys.meta_path.insert(0, Missing())
import __spark_entry__ as contract
names = contract.queries()
assert set(contract.oracle_sql()) <= set(names)
print(len([n for n in names if n.startswith("op")]), len(names))
"""


def counted(blocked):
    out = subprocess.run(
        [sys.executable, "-c", WITHOUT.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, check=True
    )
    return [int(x) for x in out.stdout.split()[-2:]]


def test_core_stands_alone():
    for blocked in (["sparkgauge.llm"], ["ahocorasick"], ["public_tokenizers", "tokenizers", "ahocorasick"]):
        operators, names = counted(blocked)
        assert operators == 0 and names > 75
