"""The entry imports, and keeps its other queries, in a copy without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
COUNT = "import __spark_entry__ as e; names = set(e.queries()); print(len(names), 'pipeline' in names, any(n.startswith('op1_') for n in names))"


@pytest.mark.parametrize("left_out", [["llm"], ["llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_without_parts(tmp_path, left_out):
    shutil.copytree(os.path.join(ROOT, "jobloom"), tmp_path / "jobloom", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path / name)
    run = subprocess.run([sys.executable, "-c", COUNT], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    count, has_pipeline, has_operators = run.stdout.split()
    assert int(count) >= 268
    assert has_pipeline == "False"
    assert has_operators == str("llm" not in left_out and os.path.exists(os.path.join(ROOT, "jobloom", "llm")))
