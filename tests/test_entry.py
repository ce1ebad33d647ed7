"""The entry point with and without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), any(k.startswith('op') for k in q))"


@pytest.mark.parametrize("left_out", [("modiste/llm", "tests/llm"), ("modiste/llm", "tests/llm", "corpus_pipeline.py")])
def test_the_rest_works_without_the_folders(tmp_path, left_out):
    from modiste.workload import all_queries

    skip = {str(ROOT / x) for x in (*left_out, ".git")}
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda at, names: [n for n in names if str(Path(at) / n) in skip or n == "__pycache__"])
    said = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(all_queries())), "False"]


def test_other_missing_modules_are_errors(tmp_path):
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_nowhere\n")
    run = f"import sys; sys.path[:0] = [{str(tmp_path)!r}, {str(ROOT)!r}]; import __spark_entry__ as e; e.queries()"
    said = subprocess.run([sys.executable, "-B", "-c", run], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode and "a_module_that_is_nowhere" in said.stderr
