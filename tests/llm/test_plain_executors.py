"""Every text query and the pipeline run where the workers cannot import this package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys, tempfile
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from plantpulse.session import build_session
spark = build_session("plain", "local[4]", **{{
    "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": {folder!r}}})
spark.sparkContext.setLogLevel("ERROR")

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_pydict({{"found": [importlib.util.find_spec("plantpulse") is not None]}})

importable.__module__ = "__main__"
assert not spark.range(1).mapInArrow(importable, "found boolean").first().found
names = [n for n in entry.queries() if n.startswith("op") and n[2].isdigit() or n == "pipeline"]
assert len(names) == 14, names
for name in names:
    assert entry.queries()[name](spark, {sf!r}).count() >= 0
    print("ran", name, flush=True)
"""


def test_workers_need_no_copy_of_the_package(sf, tmp_path):
    code = CODE.format(root=ROOT, folder=str(tmp_path / "shared"), sf=sf)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert run.returncode == 0 and run.stdout.count("ran ") == 14, run.stdout + run.stderr[-3000:]
