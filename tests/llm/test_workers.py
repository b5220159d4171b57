"""Tasks need no copy of the package: queries run from a folder where workers cannot import it."""

import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
from flightline.llm.queries import QUERIES
for name in ("op6_bpe_round_trip", "op9_jaccard_components", "op11_collocations", "op12_token_alignment", "op13_token_counts"):
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_where_the_package_is_not(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert done.returncode == 0, done.stderr[-2000:]
    told = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert told["op6_bpe_round_trip"] == told["op9_jaccard_components"] == told["op12_token_alignment"] == told["op13_token_counts"] == "200" and "op11_collocations" in told
