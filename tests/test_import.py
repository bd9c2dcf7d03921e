"""The entry module imports without a session, a JVM or Spark's jars."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[1]

CODE = """
import builtins, pathlib, socket
real = builtins.open
def no_jar(name, *a, **b):
    assert "/jars/" not in str(name), name
    return real(name, *a, **b)
builtins.open = no_jar
glob = pathlib.Path.glob
pathlib.Path.glob = lambda self, pattern, *a, **b: iter(()) if "jars" in pattern else glob(self, pattern, *a, **b)
import __spark_entry__ as e
from pyspark.sql import SparkSession
assert len(e.queries()) >= 114 and set(e.oracle_sql()) <= set(e.queries())
assert SparkSession.getActiveSession() is None
"""


def test_import_without_session():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, timeout=120)
