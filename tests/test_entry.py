"""The driver's contract holds without the training-data operators too."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from tests.conftest import ROOT

ASK = "import __spark_entry__ as e; print(*sorted(e.queries()), '|', *sorted(e.oracle_sql()))"
SKIPPED = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json", "*.txt")


@pytest.mark.parametrize("left", ["nothing", "corpus_pipeline.py", "an empty folder"])
def test_entry_without_the_training_operators(tmp_path, left):
    at = tmp_path / "repo"
    shutil.copytree(ROOT, at, ignore=SKIPPED)
    for folder in ("corvane/llm", "tests/llm"):
        shutil.rmtree(at / folder, ignore_errors=True)
    if left != "corpus_pipeline.py":
        (at / "corpus_pipeline.py").unlink(missing_ok=True)
    if left == "an empty folder":
        (at / "corvane/llm/__pycache__").mkdir(parents=True)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=at, env=env, capture_output=True, text=True, check=False)
    told = run("-c", ASK)
    assert told.returncode == 0, told.stderr
    names, oracles = (x.split() for x in told.stdout.split("|"))
    rest = {n for n in __spark_entry__.queries() if not n.startswith("op") and n != "pipeline"}
    assert set(names) == rest and set(oracles) <= rest
    found = run("-m", "pytest", "tests", "-q", "--collect-only", "-p", "no:cacheprovider")
    assert found.returncode == 0, found.stdout + found.stderr


def test_nothing_else_imports_the_training_operators():
    for folder, _, files in os.walk(ROOT):
        if os.path.relpath(folder, ROOT).startswith((".git", "corvane/llm", "tests/llm")):
            continue
        for f in files:
            if f.endswith(".py") and f not in ("corpus_pipeline.py", "__spark_entry__.py", "test_entry.py"):
                with open(os.path.join(folder, f), encoding="utf-8") as text:
                    assert "corvane.llm" not in text.read(), f
