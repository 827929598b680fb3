import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rest_works_without_optional_parts(tmp_path):
    """The subpackage for training data and the pipeline can be removed as a whole."""
    for p in ("lakeweave", "__spark_entry__.py", "bench.py"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "lakeweave/llm", ignore_errors=True)
    code = "import __spark_entry__ as e, bench; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})


def test_nothing_else_imports_the_optional_parts():
    for p in (ROOT / "lakeweave").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "lakeweave").parts:
            assert "llm" not in p.read_text(encoding="utf-8")


def test_only_missing_parts_and_libraries_are_hidden(tmp_path, monkeypatch):
    monkeypatch.syspath_prepend(str(tmp_path))
    for name, line in {"needs_library": "import xxhash.gone_from_here", "has_typo": "import lakeweave.no_such_module", "has_bad_name": "from lakeweave import nothing_like_it"}.items():
        (tmp_path / f"{name}.py").write_text(line + "\n")
    assert entry._optional("not_there") is None and entry._optional("not_there.at_all") is None and entry._optional("needs_library") is None
    for name in ("has_typo", "has_bad_name"):
        with pytest.raises(ImportError):
            entry._optional(name)
