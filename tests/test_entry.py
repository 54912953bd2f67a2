"""The driver's contract holds with and without the optional operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def test_contract():
    import __spark_entry__ as e

    names = set(e.queries())
    assert len(names) > 150 and set(e.oracle_sql()) <= names


def test_without_optional_operators(tmp_path):
    code = "import sys; sys.modules['graphloom.llm'] = None; import __spark_entry__ as e; assert not any(n.startswith('p') and n[1].isdigit() for n in e.queries()); assert 'srt02_hotspots' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_them():
    for p in (ROOT / "graphloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert "graphloom.llm" not in p.read_text(), p
