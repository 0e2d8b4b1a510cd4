"""Helpers that run in tasks must not need this package on the workers."""

import subprocess
import sys

import numpy as np
from pyspark import cloudpickle

from claimspark.operators.forest import grow_tree
from claimspark.sources.descriptions import cpt_file_entries


def run_elsewhere(payload, code, tmp_path):
    script = f"import pickle, sys\nf = pickle.loads(sys.stdin.buffer.read())\n{code}\nassert 'claimspark' not in sys.path"
    return subprocess.run([sys.executable, "-c", script], input=payload, capture_output=True, cwd=tmp_path, check=False)


def test_helpers_travel_by_value(tmp_path):
    rows = np.arange(20.0).reshape(10, 2)
    call = lambda: len(grow_tree(rows, 1, 0))
    done = run_elsewhere(cloudpickle.dumps(call), "print(f())", tmp_path)
    assert done.returncode == 0, done.stderr.decode()
    assert int(done.stdout) == call()
    code = "import io\nprint(list(f(io.BytesIO(b'Code,Description\\nA1,text\\n'), 'cpt.csv')))"
    done = run_elsewhere(cloudpickle.dumps(cpt_file_entries), code, tmp_path)
    assert done.returncode == 0, done.stderr.decode()
    assert done.stdout.decode().strip() == "[(0, 'A1', 'text')]"
