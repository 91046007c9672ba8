"""The entry point with and without its optional part."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

BLOCKED = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name in {blocked!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
sys.path.insert(0, {root!r})
import __spark_entry__ as E
names = set(E.queries())
assert set(E.oracle_sql()) <= names and "label_impressions" in names
print(len([n for n in names if n.startswith("op") and n[2].isdigit()]), "pipeline" in names)
"""


def _run(*blocked):
    done = subprocess.run([sys.executable, "-c", BLOCKED.format(blocked=list(blocked), root=ROOT)], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.split()


def test_base_queries_stay_when_a_part_cannot_be_imported():
    assert _run("public_tokenizers") == ["0", "False"]
    assert _run("adspark.llm") == ["0", "False"]
    assert _run("corpus_pipeline")[1] == "False"
