"""The driver's contract, with and without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    found = entry.entry(spark)
    assert found.columns == ["id", "page", "x", "y", "frame_w", "frame_h"] and found.count() > 0


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'grid_pack' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; print(len(q))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
