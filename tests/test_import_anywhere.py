import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

# Imports the entry from an unrelated folder, with the package's own folder unreadable for jar lookups.
SCRIPT = f"""
import glob, sys, zipfile
sys.path.insert(0, {str(REPO)!r})
glob.glob = lambda *a, **k: []
def closed(*a, **k): raise OSError("no archives here")
zipfile.ZipFile = closed
import __spark_entry__ as e
print(len(e.queries()), set(e.oracle_sql()) <= set(e.queries()))
"""


def test_entry_loads_from_another_folder(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n, ok = out.stdout.split()
    assert int(n) >= 80 and ok == "True"


def test_functions_travel_by_value():
    """No task function refers to the package by name, so executors need no copy of it."""
    from pyspark import cloudpickle

    from riskframe.functions import pvalues
    blob = cloudpickle.dumps(pvalues.chi2_sf)
    code = f"import pickle, sys; f = pickle.loads({blob!r}); print(f(3.0, 2.0)); assert 'riskframe' not in sys.modules"
    out = subprocess.run([sys.executable, "-c", code], cwd="/", capture_output=True, text=True, timeout=60)
    assert out.returncode == 0, out.stderr[-2000:]
