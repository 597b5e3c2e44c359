"""The entry module without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_imports_without_the_operators(tmp_path):
    for keep_pipeline in (True, False):
        copy = tmp_path / str(keep_pipeline)
        shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", *([] if keep_pipeline else ["corpus_pipeline.py"])))
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'w1_lead_table' in q and set(o) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
        done = subprocess.run([sys.executable, "-c", code], cwd=copy, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, check=False)
        assert done.returncode == 0, done.stderr
