"""The library without the training-data subpackage: the entry module and the other tests must not need it."""

import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT

LOOK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 50; print(sum(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q))"


def copied(tmp_path, *gone):
    keep = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json", *gone)
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=keep)


@pytest.mark.parametrize("gone", [("llm",), ("llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_the_subpackage(tmp_path, gone):
    copy = copied(tmp_path, *gone)
    env = os.environ | {"PYTHONPATH": ""}
    out = subprocess.run([sys.executable, "-c", LOOK], cwd=copy, env=env, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert "llm" not in gone or out.stdout.strip() == "0"


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(os.path.join(ROOT, "sluice")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    text = f.read()
                assert "sluice.llm" not in text and "from ..llm" not in text and "from .llm" not in text, name
