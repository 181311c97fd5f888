"""Runs and steps by blocks against those of whole keys and of memory."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators.long_runs import long_monotone, long_runs
from seqloom.operators.runs import monotone, runs


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_blocks_do_not_show(spark, block):
    rng = random.Random(block)
    rows = [(k, s, rng.random() < p, rng.randrange(5)) for k, p in (("a", 0.9), ("b", 0.5), ("c", 1.0), ("d", 0.0), (None, 0.7)) for s in rng.sample(range(-40, 90), 110)]
    rows += [("e", s, None, None) for s in range(3)]
    d = spark.createDataFrame(rows, "k string, slot int, m boolean, v int")
    got = {(r["k"], r["run_id"]): (r["start"], r["end"], r["length"], r["total"]) for r in long_runs(d, ["k"], "slot", F.col("m"), {"total": F.col("v")}, block).collect()}
    want = {(r["k"], r["run_id"]): (r["start"], r["end"], r["length"], r["total"]) for r in runs(d, ["k"], "slot", F.col("m"), [F.sum("v").alias("total")]).collect()}
    assert got == want and len(got) > 20
    for strict in (False, True):
        a = {r["k"]: r["violations"] for r in long_monotone(d, ["k"], "slot", "v", strict, block).collect()}
        assert a == {r["k"]: r["violations"] for r in monotone(d, ["k"], "slot", "v", strict).collect()}


def test_one_long_key_stays_in_blocks(spark):
    n = 300_000
    d = spark.range(n).select(F.when(F.col("id") >= 0, "all").alias("k"), "id", (F.col("id") % 100_000 != 99_999).alias("m"), (-F.col("id") % 10).alias("v"))
    got = [(r["run_id"], r["start"], r["end"], r["length"]) for r in long_runs(d, ["k"], "id", F.col("m")).orderBy("run_id").collect()]
    assert got == [(i + 1, i * 100_000, i * 100_000 + 99_998, 99_999) for i in range(3)]
    assert long_monotone(d, ["k"], "id", "v").first()["violations"] == n - n // 10
    assert long_runs(d.limit(0), ["k"], "id", F.col("m")).count() == 0 and long_monotone(d.limit(0), ["k"], "id", "v").count() == 0
