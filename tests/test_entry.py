"""The entry without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), *(n for n in e.queries() if n[:2] == 'op' and n[2].isdigit()), 'pipeline' in e.queries())"


def without(tmp_path, *gone):
    left = shutil.ignore_patterns(".git", "__pycache__", *gone)
    shutil.copytree(ROOT, tmp_path / "copy", ignore=left)
    env = os.environ | {"PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "copy", env=env, capture_output=True, text=True)


def test_entry_stands_without_the_subpackage(tmp_path):
    found = without(tmp_path, "llm")
    assert found.returncode == 0, found.stderr
    assert int(found.stdout.split()[0]) > 100 and found.stdout.split()[2:] == ["False"]


def test_entry_stands_without_the_subpackage_and_the_pipeline(tmp_path):
    found = without(tmp_path, "llm", "corpus_pipeline.py")
    assert found.returncode == 0, found.stderr
    assert found.stdout.split()[2:] == ["False"]
