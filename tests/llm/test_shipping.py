"""The training-data queries in a session made elsewhere, without PYTHONPATH."""

import os
import subprocess
import sys

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
def test_a_query_ships_the_package_to_its_workers(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = ("import sys; sys.path.insert(0, %r)\n"
            "from pyspark.sql import SparkSession\n"
            "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
            "from tidepool.llm.queries import QUERIES\n"
            "print(all(QUERIES[q](s, %r).count() for q in ('op2_token_counts', 'op12_ranked_search')))\n" % (root, SF))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.stdout.strip() == "True", out.stderr[-2000:]
