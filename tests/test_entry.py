"""The entry file without the training-data operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

# Hides regscope.llm as if its folder were gone; corpus_pipeline.py may still be there.
HIDDEN = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "regscope.llm" or name.startswith("regscope.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.path.insert(0, ROOT)
import importlib.util as u
real = u.find_spec
import __spark_entry__ as E
E.find_spec = lambda name, *a: None if name.startswith("regscope.llm") else real(name, *a)
sys.meta_path.insert(0, Hide())
names, twins = E.queries(), E.oracle_sql()
assert set(twins) <= set(names)
assert "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), sorted(names)
print(len(names))
"""


def test_registry_queries_need_no_training_data_operators():
    out = subprocess.run([sys.executable, "-c", HIDDEN.replace("ROOT", repr(ROOT))], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) >= 84


def test_nothing_else_imports_them():
    hits = []
    for folder in ("regscope", "tests"):
        for at, dirs, files in os.walk(os.path.join(ROOT, folder)):
            dirs[:] = [d for d in dirs if d not in ("llm", "__pycache__")]
            for name in files:
                if name.endswith(".py") and name != "test_entry.py":
                    with open(os.path.join(at, name), encoding="utf-8") as f:
                        hits += [name] if "regscope.llm" in f.read() else []
    assert hits == []


