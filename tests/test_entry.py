"""The entry without the optional folders."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print('pipeline' in e.queries(), sum(k.startswith('op') for k in e.queries()), len(e.oracle_sql()) > 100)"


def _copy(folder, *left_out):
    shutil.copytree(ROOT, folder, ignore=lambda path, names: [
        n for n in names if n in (".git", "__pycache__") or os.path.relpath(os.path.join(path, n), ROOT) in left_out])
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True)
    return out.stdout.split()


def test_entry_without_the_text_operators(tmp_path):
    """With and without the pipeline's file, the other queries are registered."""
    assert _copy(str(tmp_path / "a"), "fleetlens/llm", "tests/llm") == ["False", "0", "True"]
    assert _copy(str(tmp_path / "b"), "fleetlens/llm", "tests/llm", "corpus_pipeline.py") == ["False", "0", "True"]
