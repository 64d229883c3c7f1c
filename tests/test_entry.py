"""The driver's contract, with and without the training-data subpackage."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as e

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(e.SMOKE_DIR), reason="the driver's tables aren't here")
def test_entry(spark):
    assert e.entry(spark).count() > 0


def test_imports_without_the_subpackage():
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('weftline.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert e.queries() and not any(n.startswith('op') for n in e.queries()) and 'pipeline' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
