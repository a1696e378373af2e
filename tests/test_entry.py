import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "textloom.llm" or name.startswith("textloom.llm."):
            raise ImportError(name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert q and set(s) <= set(q) and not any(n.startswith("p1_") for n in q)
"""


def test_imports_without_the_subpackage():
    subprocess.run([sys.executable, "-c", HIDE], cwd=ROOT, check=True)


def test_entry_has_sql_for_known_queries_only():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_else_imports_the_subpackage():
    for f in (ROOT / "textloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert not re.search(r"\bllm\b", f.read_text())
