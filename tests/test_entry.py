"""The driver's contract, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def _names(folder):
    script = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(*q)"
    run = subprocess.run([sys.executable, "-c", script], cwd=folder, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    return set(run.stdout.split())


def test_entry_without_the_training_data_operators(tmp_path):
    kept = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(ROOT, tmp_path / "repo", ignore=kept)
    core = _names(tmp_path / "repo")
    assert "intensity_summary" in core and not any(n.startswith("op1_") for n in core)
    assert core <= _names(ROOT)
