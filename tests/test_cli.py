"""The command line lists and runs analyses."""

import os
import subprocess
import sys
import tempfile

import pyarrow.parquet as pq

from .conftest import ROOT, SF_SMALL


def test_list():
    out = subprocess.run([sys.executable, "-m", "bazaar", "list"], cwd=ROOT, capture_output=True, text=True,
                         timeout=120, check=True).stdout
    assert "rfm_buckets" in out and "lowess" in out


def test_run_writes_parquet():
    d = tempfile.mkdtemp(prefix="bazaar-cli-")
    target = os.path.join(d, "counts")
    subprocess.run([sys.executable, "-m", "bazaar", "run", "review_score_count", "--base-dir", SF_SMALL,
                    "--out", target, "--master", "local[2]"], cwd=ROOT, capture_output=True, text=True,
                   timeout=300, check=True)
    t = pq.read_table(target)
    assert t.num_rows == 5 and set(t.column_names) == {"review_score", "count"}
