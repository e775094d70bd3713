"""The entry module works without the optional training-data subpackage, with and without its pipeline module."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAID = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'class_counts' in q, 'pipeline' in q, len(e.oracle_sql()) > 30)"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_without_training_data(tmp_path, with_pipeline):
    shutil.copytree(ROOT / "quillfact", tmp_path / "quillfact", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", SAID], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    n, counts, pipeline, sql = out.stdout.split()
    assert int(n) > 30 and (counts, pipeline, sql) == ("True", "False", "True")
