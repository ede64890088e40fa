"""The entry without the subpackage of training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_entry_without_the_operators_for_training_data(tmp_path):
    shutil.copytree(REPO, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 150 and 'pipeline' not in q and 'nms' in e.oracle_sql()"
    for gone in ([], ["corpus_pipeline.py"]):
        for name in gone:
            (tmp_path / "copy" / name).unlink()
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", check=True)


def test_nothing_else_imports_the_operators_for_training_data():
    for path in (REPO / "datasheaf").rglob("*.py"):
        if "llm" not in path.parts:
            assert "datasheaf.llm" not in path.read_text(), path
