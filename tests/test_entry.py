from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_oracle_belongs_to_a_query():
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(e.oracle_sql()) <= names and e.catalog.FLAGSHIP in names


def test_entry_works_without_the_corpus_operators(tmp_path):
    """A copy without the llm folders and the pipeline still imports and lists its queries."""
    import shutil

    shutil.copytree(ROOT / "plumbline", tmp_path / "plumbline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; n = e.queries(); assert len(n) > 30 and set(e.oracle_sql()) <= set(n) and not any(k.startswith('op1') or k == 'pipeline' for k in n)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_the_corpus_operators():
    for f in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in f.parts:
            assert "plumbline.llm" not in f.read_text(), f
