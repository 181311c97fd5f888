"""Mergeable moments of vectors; numbers in groups of any size by cuts of whole orders."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import moments as M
from seqloom.operators import ordering as O
from seqloom.operators.statistics import dimension_shift


def test_vector_moments_keep_small_deviations(spark):
    rng = np.random.default_rng(1)
    rows = [(g, [float(x) for x in 1e9 + rng.random(3) * 1e-1]) for g in "ab" for _ in range(200)]
    d = spark.createDataFrame([*rows, ("a", None)], "g string, v array<double>").repartition(5)
    for r in M.vector_moments(d, ["g"], "v").collect():
        x = np.array([v for g, v in rows if g == r["g"]])
        assert r["n"] == 200 and r["mean"] == pytest.approx(x.mean(0), rel=1e-12)
        assert r["std"] == pytest.approx((x - 1e9).std(0), rel=1e-4) and r["low"] == list(x.min(0)) and r["high"] == list(x.max(0))
    with pytest.raises(Exception, match="(?i)dimension"):
        M.vector_moments(d.unionByName(spark.createDataFrame([("a", [1.0])], "g string, v array<double>")), ["g"], "v").collect()


def test_element_moments(spark):
    rng = np.random.default_rng(2)
    rows = [(g, [float(x) for x in 1e6 + rng.random(rng.integers(1, 9))]) for g in "ab" for _ in range(100)]
    d = spark.createDataFrame([*rows, ("a", []), ("a", None), ("c", [2.0])], "g string, v array<double>").repartition(4)
    got = {r["g"]: r for r in M.element_moments(d, ["g"], "v").collect()}
    for g in "ab":
        x = np.concatenate([v for k, v in rows if k == g])
        assert (got[g]["n"], got[g]["min"], got[g]["max"]) == (len(x), x.min(), x.max())
        assert got[g]["mean"] == pytest.approx(x.mean(), rel=1e-12) and got[g]["total"] == pytest.approx(x.sum()) and got[g]["variance"] == pytest.approx(x.var(), rel=1e-6)
    assert got["c"]["n"] == 1 and got["c"]["variance"] == 0


def test_dimension_shift_takes_no_vector_apart(spark):
    rng = np.random.default_rng(3)
    rows = [(s, [float(x) for x in rng.normal(i, 1, 4)]) for i, s in enumerate(("train", "val", "other")) for _ in range(50)]
    d = spark.createDataFrame(rows, "split string, v array<double>")
    s = dimension_shift(d, "v", "split", "train", "val")
    a, b = (np.array([v for k, v in rows if k == name]) for name in ("train", "val"))
    for r in s.collect():
        i = r["dim"]
        assert (r["mean_a"], r["std_a"], r["mean_b"], r["std_b"]) == pytest.approx((a[:, i].mean(), a[:, i].std(), b[:, i].mean(), b[:, i].std()))
        assert r["shift"] == pytest.approx(abs(b[:, i].mean() - a[:, i].mean()) / a[:, i].std())
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.rindex("Aggregate")  # only the groups' states are
    alone = dimension_shift(d, "v", "split", "train", "none").first()
    assert alone["mean_b"] is None and alone["shift"] is None


def test_cuts_of_whole_orders_split_a_hot_first_key(spark):
    """99 % of the rows share the first key."""
    n = 40_000
    d = spark.range(n).select(F.when(F.col("id") % 100 == 0, F.col("id")).otherwise(7).alias("a"), (n - F.col("id")).alias("b")).repartition(5)
    at = O.row_cuts(d, ["a", "b"])
    sizes = [r["count"] for r in d.groupBy(O.row_range(["a", "b"], at).alias("r")).count().collect()]
    assert len(sizes) == len(at) + 1 and max(sizes) < 2 * n / len(sizes)
    got = O.numbered(d, [], ["a", "b"], "no")
    want = sorted((i if i % 100 == 0 else 7, n - i) for i in range(n))
    assert [(r["a"], r["b"]) for r in got.orderBy("no").select("a", "b").collect()] == want
    assert got.agg(F.count_distinct("no"), F.min("no"), F.max("no"), F.max("total")).first()[:] == (n, 0, n - 1, n)


def test_numbered_with_groups_nulls_and_repeated_rows(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), rng.choice([None, "p", "q"]), rng.randrange(20)) for _ in range(500)]
    d = spark.createDataFrame([(g, i, s) for g, s, i in rows], "g string, i int, s string")
    got = O.numbered(d, ["g"], ["i", "s"], "no").collect()
    for g in "xy":
        mine = sorted(((i, s is not None, s or "") for k, s, i in rows if k == g))
        assert [(r["i"], r["s"] is not None, r["s"] or "") for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["no"])] == mine
    assert O.numbered(d.limit(0), ["g"], ["i", "s"], "no").count() == 0 and O.row_cuts(d.limit(0), ["i"]) == []
