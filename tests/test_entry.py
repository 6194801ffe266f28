"""The driver's contract, with the text operators and without."""

import os
import shutil
import subprocess
import sys

from helpers import ROOT


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_works_without_the_text_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'spmv_csr' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=env, timeout=120)
