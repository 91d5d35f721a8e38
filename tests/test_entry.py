import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_sql_belongs_to_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_llm_and_the_entry_works_without_it(tmp_path):
    for path in (ROOT / "helixloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"helixloom\.llm|corpus_pipeline", path.read_text()), path
    code = "import sys; sys.modules['helixloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(*sorted(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout
    assert "q26_assembly" in out and "op1_" not in out
