"""The optional sub-package is optional."""

import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_nothing_else_imports_the_optional_package():
    for path in [*ROOT.glob("weftlens/**/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert "weftlens.llm" not in path.read_text(), path


def test_entry_without_the_optional_package(tmp_path):
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    for path in ROOT.glob("weftlens/**/*.py"):
        relative = path.relative_to(ROOT)
        if "llm" not in relative.parts:
            (tmp_path / relative).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / relative).write_text(path.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'topn_per_source' in q and not [n for n in q if n.startswith('p')]; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True).returncode == 0


def test_entry(spark):
    contract = importlib.import_module("__spark_entry__")
    assert contract.entry(spark).columns == ["source_file", "row_id", "rank", "words", "text_hash"]
    assert set(contract.oracle_sql()) <= set(contract.queries())
