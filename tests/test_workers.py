"""Code for Python workers travels with the function: an executor without this package can load it."""

import subprocess
import sys

import pytest
from pyspark import cloudpickle

from marketlake.operators import ledger, users
from marketlake.streaming import jobs


@pytest.mark.parametrize("fn", [ledger._summed, ledger._passed, ledger._walk, ledger._closed, users._in_order, jobs._indicate])
def test_loads_without_the_package(fn, tmp_path):
    code = "import pickle, sys; f = pickle.loads(sys.stdin.buffer.read()); assert 'marketlake' not in sys.modules; print(f.__name__)"
    done = subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(fn), cwd=tmp_path, capture_output=True, timeout=60)
    assert done.returncode == 0, done.stderr.decode()
    assert done.stdout.decode().strip() == fn.__name__
