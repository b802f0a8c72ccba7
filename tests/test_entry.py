"""The driver's contract, and that the library works without the training-data operators."""

import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parents[1]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and "search_lang_ci" in entry.queries()


def test_entry_and_queries_without_llm(tmp_path):
    for name in ("docmill", "__spark_entry__.py"):
        os.symlink(REPO / name, tmp_path / name) if name.endswith(".py") else (tmp_path / name).mkdir()
    for part in (REPO / "docmill").iterdir():
        if part.name not in ("llm", "__pycache__"):
            os.symlink(part, tmp_path / "docmill" / part.name)
    # a copy, so that the entry's own folder is the one without llm
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_lang_ci' in q and not any(k.startswith('op') or k == 'pipeline' for k in q if k != 'operation_times'); print(len(q), len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_queries_without_a_library(tmp_path):
    (tmp_path / "zstandard.py").write_text("raise ImportError('not here')")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_lang_ci' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=REPO, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{REPO}"}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
