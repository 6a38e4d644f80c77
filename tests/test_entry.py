"""The driver contract with and without the text operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q))"


def said(tmp_path, gone):
    """What the entry says of a copy of the library without some of its parts."""
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "sonaria"), copy / "sonaria", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), copy / name)
    gone(copy)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SAY], cwd=copy, env=env, capture_output=True, text=True, check=True)
    n, pipeline, operators = run.stdout.split()
    assert int(n) >= 180
    return pipeline == "True", operators == "True"


def test_entry_without_the_text_operators(tmp_path):
    def folder(copy):
        shutil.rmtree(copy / "sonaria" / "llm", ignore_errors=True)

    assert said(tmp_path, folder) == (False, False)


def test_entry_without_operators_and_pipeline(tmp_path):
    def both(copy):
        shutil.rmtree(copy / "sonaria" / "llm", ignore_errors=True)
        (copy / "corpus_pipeline.py").unlink(missing_ok=True)

    assert said(tmp_path, both) == (False, False)


def test_entry_with_an_empty_folder_left(tmp_path):
    def emptied(copy):
        shutil.rmtree(copy / "sonaria" / "llm", ignore_errors=True)
        os.makedirs(copy / "sonaria" / "llm" / "__pycache__")

    assert said(tmp_path, emptied) == (False, False)
