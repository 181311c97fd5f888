import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import distribution as D
from seqloom.operators import rollup as R
from seqloom.operators import statistics as C
from seqloom.operators.ordering import cuts, numbered, percentiles, value_counts_before, with_average_rank


def column(spark, values, name="x", kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}")


def test_summary_equals_numpy_and_skips_bad_values(spark):
    v = np.random.default_rng(1).normal(size=101).tolist()
    r = D.summarize(column(spark, v + [None, float("nan"), float("inf")]), [], F.col("x")).first()
    assert r.n == 101 and math.isclose(r.std, np.std(v)) and math.isclose(r.mean, np.mean(v))
    for p, name in ((1, "p01"), (5, "p05"), (50, "median"), (75, "p75"), (90, "p90"), (95, "p95"), (99, "p99")):
        assert math.isclose(r[name], np.percentile(v, p))
    e = D.summarize(column(spark, [float("nan")]), [], F.col("x")).first()
    assert e.n == 0 and all(e[c] is None for c in ("min", "mean", "std", "median", "max"))


def test_histogram_cumulative_concentration(spark):
    d = column(spark, [0, 1, 2], kind="int")
    assert [(r.value, r.n) for r in D.dense_histogram(d, F.col("x"), 0, 3).orderBy("value").collect()] == [(0, 1), (1, 1), (2, 1), (3, 0)]
    assert np.allclose([r.share for r in D.cumulative_counts(d, F.col("x"), 2).orderBy("limit").collect()], [1 / 3, 2 / 3, 1])
    c = {r.percent: r.share for r in D.concentration(column(spark, [9, 1, 0], kind="int"), F.col("x")).collect()}
    assert c[1] == pytest.approx(0.9)
    assert {r.share for r in D.concentration(column(spark, [0, 0], kind="int"), F.col("x")).collect()} == {0.0}
    b = d.agg(*D.buckets(F.col("x"), (("none", 0, 0), ("more", 1, None)))).first()
    assert (b.none, b.more) == (1, 2)


def test_ranks_and_correlations(spark):
    r = with_average_rank(column(spark, [1.0, 2.0, 2.0, 3.0]), "x", [], "r").orderBy("i").collect()
    assert [x.r for x in r] == [1.0, 2.5, 2.5, 4.0]
    d = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0), (None, 1.0, 5.0)], "a double, b double, k double")
    c = C.correlations(d, "a", "b").first()
    assert c.n == 3 and c.spearman == pytest.approx(1) and c.pearson == pytest.approx(np.corrcoef([1, 2, 3], [2, 4, 7])[0, 1])
    assert C.correlations(d, "a", "k").first().pearson is None
    assert C.correlations(d.limit(1), "a", "b").first().pearson is None
    same = spark.createDataFrame([(1, 1), (1, 1), (2, 3)], "a int, b int")
    assert C.correlations(same, "a", "b").first().spearman == pytest.approx(1)


def test_order_of_large_groups(spark):
    """Many ranges, hot values, null groups: the same as numpy, without a window over a group."""
    rng = np.random.default_rng(3)
    rows = [("a", float(x)) for x in rng.integers(0, 40, 900)] + [(None, float(x)) for x in rng.normal(size=700)] + [("b", 1.5)] + [("c", None)] * 3
    d = spark.createDataFrame(rows, "g string, x double").repartition(5)
    by = {g: np.array([x for k, x in rows if k == g and x is not None]) for g in ("a", None, "b")}
    got = {r.g: r for r in percentiles(d, ["g"], F.col("x"), [("low", 0.01), ("mid", 0.5), ("high", 0.97), ("top", 1.0)]).collect()}
    assert set(got) == set(by)
    for g, v in by.items():
        assert np.allclose([got[g].low, got[g].mid, got[g].high, got[g].top], np.quantile(v, [0.01, 0.5, 0.97, 1.0]))
    for r in value_counts_before(d, ["g"], "x").collect():
        assert r.before == (by[r.g] < r.x).sum() and r.n == (by[r.g] == r.x).sum() and r.total == len(by[r.g])
    ranks = with_average_rank(d, "x", ["g"], "r").collect()
    assert len(ranks) == len(rows) and all(r.r is None if r.x is None else r.r == (by[r.g] < r.x).sum() + ((by[r.g] == r.x).sum() + 1) / 2 for r in ranks)
    n = numbered(d.where("x IS NOT NULL").withColumn("id", F.monotonically_increasing_id()), [], ["x", "id"], "i").orderBy("i").collect()
    assert [r.i for r in n] == list(range(len(rows) - 3)) and [r.x for r in n] == sorted(r.x for r in n)
    assert len(cuts(d.select("x").distinct(), "x")) >= 2 and percentiles(d.limit(0), [], F.col("x"), [("m", 0.5)]).first()[0] is None
    plan = percentiles(d, ["g"], F.col("x"), [("m", 0.5)])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan


def test_two_class_and_confusion(spark):
    d = spark.createDataFrame([(2.0, 0.0, 0), (0.0, 1.0, 0), (1.0, 1.0, 0)], "l0 double, l1 double, y int")
    r = d.withColumn("r", C.two_class(F.col("l0"), F.col("l1"), F.col("y"))).select("y", "r.*").collect()
    assert [x.prediction for x in r] == [0, 1, 0]
    assert r[0].loss == pytest.approx(math.log(1 + math.exp(-2))) and r[2].p0 == pytest.approx(0.5)
    c = C.confusion(spark.createDataFrame([(0, 0), (0, 1)], "y int, p int"), F.col("y"), F.col("p")).first()
    assert (c.tn, c.fp, c.fn, c.tp) == (1, 1, 0, 0) and c.accuracy == 0.5 and c.f1 == 0.0 and c.precision == 0.0


def test_series(spark):
    rows = [("a", i, x) for i, x in enumerate([5.0, 4.0, 4.0, 4.5, 3.9, 6.0, 6.0])]
    d = spark.createDataFrame(rows, "run string, epoch int, loss double")
    s = C.early_stop(d, "run", "epoch", "loss", patience=2).first()
    assert (s.best_epoch, s.best, s.stop_epoch) == (1, 4.0, 3)
    s = C.early_stop(d, "run", "epoch", "loss", patience=3).first()
    assert (s.best_epoch, s.stop_epoch) == (4, None)
    s = C.early_stop(d, "run", "epoch", "loss", patience=3, min_delta=0.5).first()
    assert (s.best_epoch, s.stop_epoch) == (1, 4)
    e = C.epoch_series(d, "run", "epoch", "loss").first()
    assert e.best_epoch == 4 and e.final == 6.0 and e.std == pytest.approx(np.std([r[2] for r in rows], ddof=1))


def test_cube_and_spine(spark):
    d = spark.createDataFrame([("train", "pos", 1), ("train", "neg", 2), ("val", "pos", 3)], "split string, label string, n int")
    got = {(r.group_type, r.split, r.label): r.s for r in R.cube(d, ["split", "label"], [F.sum("n").alias("s")]).collect()}
    assert got[("overall", None, None)] == 6 and got[("split", "train", None)] == 3 and got[("split*label", "val", "pos")] == 3 and len(got) == 8
    spine = spark.createDataFrame([("val", "neg")], "split string, label string")
    assert R.zero_filled(d, spine, ["split", "label"], ["n"]).first().n == 0
    one = spark.range(1)
    assert one.select(R.ratio(F.lit(1), F.lit(0)).alias("r")).first().r == 0.0 and one.select(R.ratio(F.lit(1), F.lit(0), None).alias("r")).first().r is None


def test_dimension_shift(spark):
    d = spark.createDataFrame([("t", [0.0, 1.0]), ("t", [2.0, 1.0]), ("v", [3.0, 1.0])], "s string, v array<double>")
    s = C.dimension_shift(d, "v", "s", "t", "v").orderBy("dim").collect()
    assert s[0].shift == pytest.approx(2.0) and s[1].shift == 0.0
    m = C.mean_vector_comparison(C.dimension_shift(d, "v", "s", "t", "v")).first()
    assert m.l2 == pytest.approx(2.0)
    zero = spark.createDataFrame([("t", [0.0]), ("v", [1.0])], "s string, v array<double>")
    assert C.mean_vector_comparison(C.dimension_shift(zero, "v", "s", "t", "v")).first().cosine is None
