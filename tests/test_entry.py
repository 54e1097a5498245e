import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_its_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 4, 5, 6)} <= set(entry.queries())


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "chronoloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert not re.search(r"chronoloom\.llm|from \.*llm", path.read_text()), path


def test_imports_without_the_subpackage(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Block(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('chronoloom.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "assert 'p1_found' in e.queries() and 'p2_found' not in e.queries() and e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
