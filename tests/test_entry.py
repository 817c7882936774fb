"""The driver's entry without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
COUNT = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"


@pytest.mark.parametrize("left", ["nothing", "empty folder", "pipeline"])
def test_entry_imports_without_the_subpackage(tmp_path, left):
    shutil.copytree(ROOT / "verdictflow", tmp_path / "verdictflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if left == "empty folder":
        (tmp_path / "verdictflow/llm").mkdir()
    if left != "nothing" and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True)
    n, of_subpackage, known = done.stdout.split()
    assert int(n) > 80 and of_subpackage == "0" and known == "True"


def test_faults_of_the_subpackage_are_not_swallowed(tmp_path):
    shutil.copytree(ROOT / "verdictflow", tmp_path / "verdictflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("from verdictflow.llm import absent\n")
    (tmp_path / "verdictflow/llm").mkdir()
    (tmp_path / "verdictflow/llm/__init__.py").write_text("")
    done = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode and "absent" in done.stderr
