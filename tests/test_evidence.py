"""Evidence of named differences, by literal cases."""

import pytest

from seqloom.operators import evidence as E

RANGE = "model string, label string, split string, metric string, p10 double, median double, p90 double"


def ranges(spark, moved):
    """Two models, three metrics, two labels and all; (model, label, metric) in ``moved`` stand
    outside on the validation side."""
    rows = []
    for model in "ab":
        for label in (None, "drowsy", "alert"):
            for metric in ("mean", "norm", "std"):
                rows.append((model, label, "train", metric, 0.0, 0.5, 1.0))
                rows.append((model, label, "val", metric, 0.5, 1.5 if (model, label, metric) in moved else 1.0, 2.0))
    return spark.createDataFrame(rows, RANGE)


def feature(spark, moved, shifts):
    s = spark.createDataFrame([(m, *x) for m, x in zip("ab", shifts, strict=True)], "model string, p95 double, cosine double")
    rows = E.feature_shift_evidence(ranges(spark, moved), s, models=2).collect()
    results = {r.result for r in rows}
    assert len(results) == 1
    return results.pop(), {(r.model, r.label): (r.outside, r.dimension_large, r.center_large, r.flag) for r in rows}


CALM = [(0.1, 1.0), (0.1, None)]


@pytest.mark.parametrize(("moved", "shifts", "result"), [
    ((), CALM, "NO_OBVIOUS_FEATURE_DISTRIBUTION_SHIFT"),
    ([("a", None, "mean")], CALM, "MIXED"),
    ([("a", None, "mean"), ("a", None, "std")], CALM, "BACKBONE_SPECIFIC_SHIFT"),
    ((), [(0.5, 0.98), (0.7, 0.5)], "POSSIBLE_FEATURE_DISTRIBUTION_SHIFT"),
    ([("b", "alert", "mean"), ("b", "alert", "norm")], CALM, "LABEL_CONDITIONAL_SHIFT"),
])
def test_feature_shift(spark, moved, shifts, result):
    got, rows = feature(spark, set(moved), shifts)
    assert got == result
    for i, m in enumerate("ab"):
        p95, cosine = shifts[i]
        out = sorted(metric for model, label, metric in moved if (model, label) == (m, None))
        large, away = p95 >= 0.5, cosine is not None and cosine < 0.99
        assert rows[m, None] == (out, large, away, len(out) + large + away >= 2)
    parts = {k: v[0] for k, v in rows.items() if k[1]}
    assert parts == ({("b", "alert"): ["mean", "norm"]} if result.startswith("LABEL") else {})


def test_the_ends_of_a_range_are_inside(spark):
    d = spark.createDataFrame([("a", s, m, lo, med, hi) for s, m, lo, med, hi in (("x", "p", 0.0, 0.5, 1.0), ("y", "p", 0.0, 1.0, 2.0), ("x", "q", 0.0, 0.5, 1.0), ("y", "q", 0.0, -0.1, 2.0), ("y", "only", 0.0, 9.0, 9.0))], "model string, side string, metric string, p10 double, median double, p90 double")
    assert E.metrics_outside(d, ["model"], "side", "y", "x").first()["outside"] == ["q"]
    assert E.metrics_outside(d.limit(0), ["model"], "side", "y", "x").count() == 0


@pytest.mark.parametrize(("moved", "rates", "result"), [
    ((), (0.8, 0.7), "NO_OBVIOUS_TEMPORAL_SHIFT"),
    ((), (0.8, 0.9), "POSSIBLE_TEMPORAL_REDUNDANCY"),
    ([("b", None, "mean"), ("b", None, "std")], (0.1, 0.9), "POSSIBLE_TEMPORAL_SPLIT_SHIFT"),
    ([("b", None, "mean"), ("b", None, "std")], (0.9, 0.9), "MIXED"),
    ([("b", "drowsy", "mean"), ("b", "drowsy", "std")], (0.9, 0.1), "LABEL_CONDITIONAL_TEMPORAL_PATTERN"),
])
def test_temporal(spark, moved, rates, result):
    near = spark.createDataFrame([("a", "train", rates[0]), ("a", "val", rates[1]), ("b", "train", 0.1), ("b", "val", 0.9)], "model string, split string, rate double")
    d = ranges(spark, set(moved))
    if moved and moved[0][1]:  # a label whose median leaves the other label's range in one split
        d = d.where("label IS NULL OR split = 'val'").unionByName(d.where("label IS NOT NULL AND split = 'train'"))
        d = d.selectExpr("model", "label", "split", "metric", "p10", "IF(label IS NOT NULL AND median > 1, 5.0D, median) AS median", "p90")
    rows = E.temporal_evidence(d, near, ("alert", "drowsy")).collect()
    assert {r.result for r in rows} == {result}
    flags = {(r.criterion, r.model, r.split) for r in rows if r.flag}
    assert ("redundancy", "a", None) in flags if min(rates) >= 0.8 else ("redundancy", "a", None) not in flags
    assert (("split", "b", None) in flags) == (bool(moved) and moved[0][1] is None)
    assert {f for f in flags if f[0] == "label"} == ({("label", "b", "val")} if result.startswith("LABEL") else set())
    assert len(rows) == 2 + 2 + 4


def test_loss(spark):
    rows = [(i, float(30 - i), float(i), i % 2 == 0, i % 3 == 0) for i in range(30)]
    d = spark.createDataFrame(rows, "id int, la double, lb double, ca boolean, cb boolean")
    models = (("x", "la", "ca"), ("y", "lb", "cb"))
    r = E.loss_evidence(d, "id", models).first()
    assert (r.both_incorrect, r.x_only_incorrect, r.y_only_incorrect, r.both_high_loss) == (10, 5, 10, 10)
    assert r.share_x == pytest.approx((30 + 29 + 28) / 465) and r.share_y == pytest.approx((29 + 28 + 27) / 435)
    assert (r.concentrated, r.shared, r.model_specific, r.result) == (False, True, True, "MIXED")
    none = E.loss_evidence(d.limit(0), "id", models).first()
    assert (none.share_x, none.both_high_loss, none.result) == (0, 0, "BROAD_VALIDATION_DIFFICULTY")
    hot = spark.createDataFrame([(0, 99.0, 1.0, True, True), (1, 0.5, 1.0, True, True)], "id int, la double, lb double, ca boolean, cb boolean")
    assert E.loss_evidence(hot, "id", models).first()["result"] == "LOSS_CONCENTRATED_IN_FEW_SAMPLES"


def test_review(spark):
    rows = [("p", True, True, True, False, None)] * 2 + [("p", True, False, False, False, None)] * 2 + [("p", False, False, True, False, None)] * 4
    rows += [("q", True, True, False, True, True), ("q", False, False, False, False, True), ("r", True, True, True, True, True)]
    d = spark.createDataFrame(rows, "g string, hard boolean, dark boolean, framed boolean, brief boolean, doubt boolean")
    got = {r.g: (r.repeated_quality_fields, r.matched_patterns, r.result) for r in E.review_evidence(d, ["g"], "hard", ["dark", "framed"], "brief", "doubt").collect()}
    assert got["p"] == (["dark"], ["VISUAL_DATA_QUALITY_PATTERN"], "VISUAL_DATA_QUALITY_PATTERN")
    assert got["q"] == (["dark"], ["VISUAL_DATA_QUALITY_PATTERN", "BRIEF_OR_AMBIGUOUS_TEMPORAL_CUES"], "MIXED")
    assert got["r"] == ([], [], "NO_OBVIOUS_VISUAL_EXPLANATION")  # no controls
