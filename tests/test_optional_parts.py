"""The entry works without the text operators, and does not hide errors in them."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SHOW = "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"


def copy(tmp_path, *without):
    skip = shutil.ignore_patterns(".git", "__pycache__", *without)
    return shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)


def run(folder):
    return subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, timeout=120,
                          env=os.environ | {"PYTHONPATH": ""})


def test_without_text_operators(tmp_path):
    done = run(copy(tmp_path, "llm", "corpus_pipeline.py"))
    assert done.returncode == 0, done.stderr
    count, pipeline, text = done.stdout.split()
    assert int(count) > 120 and (pipeline, text) == ("False", "False")


def test_an_error_inside_shows(tmp_path):
    folder = copy(tmp_path, "llm", "corpus_pipeline.py")
    os.makedirs(folder / "plantpulse" / "llm")
    (folder / "plantpulse" / "llm" / "queries.py").write_text("import no_such_module\n")
    done = run(folder)
    assert done.returncode != 0 and "no_such_module" in done.stderr
