"""The package works from any working directory, and patterns can come from the caller."""

import os
import subprocess
import sys

from tidewatch.operators.patterns import theme_rates

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
from tidewatch.session import build_session
spark = build_session("elsewhere", 2)
print("ROWS", e.queries()["parse_reply"](spark, "/root/testdata/sf0.001").count())
"""


def test_python_workers_find_the_package_from_elsewhere(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "ROWS 164" in run.stdout, run.stderr[-2000:]


def test_theme_rates_with_own_patterns(spark):
    df = spark.createDataFrame([("a", "Red green"), ("a", "green"), ("b", "blue blue")], "model string, t string")
    own = [("colour", "red", "red", 1), ("colour", "blues", "blue", 2), ("other", "x", "x", 1)]
    table = spark.createDataFrame([(t, l, r, k) for t, l, r, k in own], "theme string, label string, regex string, least int")
    for dictionary in (own, table):
        got = {(r.model, r.label): (r.hits, r.pct) for r in theme_rates(df, "t", "colour", ["model"], dictionary=dictionary).collect()}
        assert got == {("a", "red"): (1, 50), ("a", "blues"): (0, 0), ("b", "red"): (0, 0), ("b", "blues"): (1, 100)}
