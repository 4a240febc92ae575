"""The driver contract, loaded the way an outside harness loads it: a fresh
process started in another folder, the entry module imported by file path.
Python code that runs inside Spark's workers (Q-C state processor, footer
reader) must not depend on the package being importable there."""

import os
import subprocess
import sys
import tempfile

from conftest import ROOT, SF_SMALL

SCRIPT = """
import importlib.util, sys, tempfile
spec = importlib.util.spec_from_file_location("entry_under_test", sys.argv[1])
E = importlib.util.module_from_spec(spec)
spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]")
         .config("spark.sql.shuffle.partitions", "4")
         .config("spark.ui.enabled", "false")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fs-entry-"))
         .getOrCreate())
print("entry", E.entry(spark).count())
qs = E.queries()
for name in ("qc_stateful", "table_sizes"):
    print(name, qs[name](spark, sys.argv[2]).count())
spark.stop()
"""


def test_entry_runs_from_another_folder():
    cwd = tempfile.mkdtemp(prefix="fs-elsewhere-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    r = subprocess.run([sys.executable, "-c", SCRIPT, os.path.join(ROOT, "__spark_entry__.py"),
                        SF_SMALL], cwd=cwd, env=env, capture_output=True, text=True,
                       timeout=600)
    assert r.returncode == 0, r.stderr[-3000:]
    lines = dict(line.split() for line in r.stdout.splitlines()
                 if line.split()[:1] and line.split()[0] in ("entry", "qc_stateful",
                                                             "table_sizes"))
    assert int(lines["entry"]) == 7
    assert int(lines["qc_stateful"]) == 7
    assert int(lines["table_sizes"]) > 0
