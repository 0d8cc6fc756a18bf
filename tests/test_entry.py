import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
USED = """
import __spark_entry__ as entry
names = set(entry.queries())
assert {"file_summary", "lint_all"} <= names, names
assert not [n for n in names if n.startswith("op") or n == "pipeline"], names
assert set(entry.oracle_sql()) <= names
"""


@pytest.mark.parametrize("pipeline_left", [False, True])
def test_entry_without_the_training_data_operators(tmp_path, pipeline_left):
    """The other queries stay when the subpackage goes, with or without the pipeline file."""
    leave = shutil.ignore_patterns("llm", "__pycache__")
    for folder in ("srcgauge", "oracles"):
        shutil.copytree(ROOT / folder, tmp_path / folder, ignore=leave)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline_left:
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    got = subprocess.run(
        [sys.executable, "-c", USED], cwd=tmp_path, capture_output=True, text=True, timeout=120
    )
    assert got.returncode == 0, got.stderr
