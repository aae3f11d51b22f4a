"""Arrow operators in Python workers that hold nothing from the task before, as after a lost executor."""

import subprocess
import sys
from pathlib import Path

import pytest

REPO = str(Path(__file__).resolve().parents[2])
CODE = """
import os, sys
repo, name, sf = sys.argv[1:]
sys.path.insert(0, repo)
os.environ["PYTHONPATH"] = os.pathsep.join([repo, os.environ.get("PYTHONPATH", "")])
from pyspark.sql import SparkSession
from tidemark.llm import queries
b = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
spark = b.config("spark.python.worker.reuse", "false").getOrCreate()
for q in name.split(","):
    print(q, queries.queries()[q](spark, sf).count())
spark.stop()
"""


@pytest.mark.parametrize("names", ["op1_prefix_forest,op2_suffix_dedup,op4_ngram_join,op5_media_columns,op6_lm_scoring,op8_quality,op10_packing"])
def test_each_operator_in_fresh_workers(names, sf):
    done = subprocess.run([sys.executable, "-c", CODE, REPO, names, sf], capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    got = dict(line.split() for line in done.stdout.splitlines() if line.startswith("op"))
    assert set(got) == set(names.split(",")) and all(int(n) > 0 for n in got.values())
