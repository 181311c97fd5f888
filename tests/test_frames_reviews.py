import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import geometry as G
from seqloom.functions import scalars as S
from seqloom.operators import frames as O
from seqloom.operators import review as V
from seqloom.operators import shifts as H


def test_chained_substitutes_are_found(spark):
    """Slot 2 takes slot 1, which is itself imputed from slot 0."""
    rows = [(0, True, 0), (1, False, 0), (2, False, 1), (3, True, 3)]
    p = spark.createDataFrame([("v", t, t * 3, t * 0.3, ok, not ok, s, s * 3, s * 0.3, f"v/{s}.jpg", s - t, abs(s - t), (s - t) * 3) for t, ok, s in rows], "video_id string, target_context_index int, target_canonical_index int, target_timestamp_sec double, original_available boolean, imputed boolean, source_context_index int, source_canonical_index int, source_timestamp_sec double, source_image_relpath string, imputation_offset_context_slots int, imputation_distance_context_slots int, imputation_offset_canonical_slots int")
    got = {(r.target_context_index, r.error) for r in O.context_plan_errors(p, slots=4).collect()}
    assert got == {(2, "CHAINED_SOURCE"), (2, "NEAREST_SOURCE"), (2, "SOURCE_PROVENANCE")}
    assert {r.error for r in O.context_plan_errors(p.where("target_context_index < 3"), slots=4).where("target_context_index IS NULL").collect()} == {"SLOTS"}


def test_representative_slots(spark):
    missing = {"a": range(10, 21), "b": [50], "c": [], "d": range(100), "e": [0]}
    frames = spark.createDataFrame([(v, i, i not in m, i % 3 == 0, i % 3 == 0 and i not in m) for v, m in missing.items() for i in range(100)], "video_id string, canonical_index int, yunet_success boolean, context_selected boolean, context_crop_available boolean")
    why = spark.createDataFrame([("a", "longest_consecutive_run"), ("b", "isolated_single_miss"), ("c", "zero_missing_reference"), ("d", "x"), ("e", "highest_context_missing")], "video_id string, reason string")
    got = {r.video_id: r.slots for r in O.representative_slots(frames, why).collect()}
    assert got == {"a": [9, 10, 15, 20, 21], "b": [49, 50, 51], "c": [0, 50, 99], "d": [0, 25, 50, 75, 99], "e": [0, 3]}
    wrong = O.representative_slots(frames, spark.createDataFrame([("a", "zero_missing_reference")], "video_id string, reason string")).first()
    assert wrong.slots is None


def test_geometry(spark):
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    box = G.box(F.lit(10), F.lit(10), F.lit(60), F.lit(60))
    check = lambda p, ear=0.3, pose=True: spark.range(1).select(G.valid_geometry(box, p, F.lit(100), F.lit(100), F.lit(ear).cast("double"), F.lit(0.5), F.lit(pose), 0.1, 40, (0.1, 0.5), (0.0, 1.0)).alias("v")).first().v
    good = F.array(*[point(20, 20)] * 68)
    assert check(good).valid and not check(good).suspicious
    v = check(F.array(*[point(20, 20)] * 67, point(300, 20)), ear=0.9, pose=False)
    assert not v.landmark_valid and v.suspicious_reasons == ["LANDMARK_OUTSIDE_FRAME", "LANDMARK_OUTSIDE_BBOX", "SUSPICIOUS_EAR_EXTREME"] and v.failure_reasons == ["LANDMARK_OUTSIDE_FRAME_TOLERANCE", "HEAD_POSE_INVALID"]
    v = check(F.array(*[point(20, 20)] * 67), ear=None)
    assert v.failure_reasons == ["INVALID_LANDMARKS", "EAR_INVALID"] and not v.suspicious_reasons
    assert G.padding_color() == (104, 116, 124)


def test_points_of_a_face_are_made_once(spark):
    points = F.array(*[F.struct(F.col("id").cast("double").alias("x"), F.when(F.col("id") != i, F.lit(20.0)).alias("y")) for i in range(68)])
    box = G.box(F.lit(10), F.lit(10), F.lit(60), F.lit(60))
    v = spark.range(50, 101, 25).select("id", G.valid_geometry(box, points, F.lit(100), F.lit(100), F.lit(0.3), F.lit(0.5), F.lit(True), 0.1, 40, (0.1, 0.5), (0.0, 1.0)).alias("v"))
    assert {r.id: (r.v.valid, r.v.suspicious_reasons) for r in v.collect()} == {50: (False, []), 75: (True, ["LANDMARK_OUTSIDE_BBOX"]), 100: (True, ["LANDMARK_OUTSIDE_BBOX"])}
    plan = v.select("v.valid", "v.suspicious", "v.failure_reasons")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_min(") == 2


def test_rules_name_shifts(spark):
    one = lambda c: spark.range(1).select(c.alias("r")).first().r
    f = lambda *v: [F.lit(float(x)) for x in v]
    assert one(H.sequence_shift(*f(0.02, 0.06, 1, 0, 0))) == "POSSIBLE_SEQUENCE_QUALITY_SHIFT"
    assert one(H.sequence_shift(*f(0.001, 0, 0, 0, 0.06))) == "LOCALIZED_SLOT_SHIFT" and one(H.sequence_shift(*f(0.006, 0, 0, 0, 0))) == "MIXED" and one(H.sequence_shift(*f(0, 0, 0, 0, 0))).startswith("NO_")
    assert one(H.feature_shift(F.lit(1), 2, F.lit(True), F.lit(True))) == "BACKBONE_SPECIFIC_SHIFT" and one(H.feature_shift(F.lit(0), 2, F.lit(True), F.lit(True))) == "LABEL_CONDITIONAL_SHIFT"
    assert one(H.loss_result(*f(0.2, 12, 5, 5, 4))) == "MIXED" and one(H.loss_result(*f(0.5, 12, 5, 5, 4))).startswith("LOSS_")
    pair = lambda a, b: (F.lit(a), F.lit(b))
    assert one(H.review_result([pair(0.6, 0.5), pair(0.5, 0.3)], pair(0.1, 0.0), pair(0.0, 0.0))) == "VISUAL_DATA_QUALITY_PATTERN"
    assert one(H.difference_cause(F.lit(False), F.lit(False), F.lit(0), F.lit(True))) == "UNRESOLVED"


def test_reviews(spark):
    d = spark.createDataFrame([("x", "a"), ("y", "a"), ("x", None)], "v string, g string")
    assert {(r.scope, r.value): (r.n, round(r.rate, 3)) for r in V.rates(d.where("g IS NOT NULL"), "v", ["x", "z"], "g").collect()} == {("overall", "x"): (1, 0.5), ("overall", "z"): (0, 0.0), ("a", "x"): (1, 0.5), ("a", "z"): (0, 0.0)}
    with pytest.raises(ValueError):
        V.rewritten(d, {"g": F.lit(1)}, ["g"])
    e = {r.name: r.matches for r in V.against_expected(spark.createDataFrame([("n", 2.0), ("m", 1.0)], "name string, value double"), {"n": 2.0000001, "k": 1}, 1e-6).collect()}
    assert e == {"n": True, "m": False, "k": False}
    with pytest.raises(ValueError):
        S.overridden("dropout", 0.1, 0.5, None)
    assert S.overridden("dropout", 0.1, 0.5, "wide") == 0.5 and S.overridden("norm", True, None, None) is True
    with pytest.raises(ValueError):
        S.run_names("net", 1, "-bad")


def test_distinct_places_of_a_video(spark):
    from seqloom.operators.frames import distinct_below

    d = spark.createDataFrame([(x,) for x in [0, 62, 63, 63, 99, 100, -1, None]], "i int")
    a = d.agg(distinct_below(F.col("i"), 100).alias("n"), distinct_below(F.col("i"), 63).alias("few"), distinct_below(F.when(F.col("i") > 500, F.col("i")), 100).alias("none"))
    assert tuple(a.first()) == (4, 2, 0) and "Expand" not in a._jdf.queryExecution().optimizedPlan().toString()


PAIRS = (("raw", "m05"), ("raw", "m10"), ("raw", "m15"), ("m05", "m10"), ("m10", "m15"))
FEATURES, ANGLES = ("ear", "mar", "pitch_raw", "yaw", "roll"), ("pitch_raw", "yaw", "roll")


def test_differences_of_all_pairs_and_features(spark):
    """Angles across 180, values that are null or no number, a candidate without any."""
    rng = np.random.default_rng(7)
    names = [f"{c}_{f}" for c in ("raw", "m05", "m10", "m15") for f in FEATURES]
    v = rng.uniform(-400, 400, (60, len(names))).round(1)
    v[::7, names.index("m05_ear")] = np.nan
    v[:3, [names.index("raw_yaw"), names.index("m10_yaw")]] = (179.5, -179.5)
    v[:, names.index("m15_roll")] = np.nan
    rows = [(i, *[None if np.isnan(x) and (i + k) % 2 else float(x) for k, x in enumerate(r)]) for i, r in enumerate(v)]
    d = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names))
    got = {(r.pair, r.feature): r for r in V.pairwise_differences(d, "id", FEATURES, ANGLES, PAIRS).collect()}
    assert set(got) == {(f"{a}_{b}", f) for a, b in PAIRS for f in FEATURES}
    for a, b in PAIRS:
        for f in FEATURES:
            x = v[:, names.index(f"{a}_{f}")] - v[:, names.index(f"{b}_{f}")]
            x = np.abs((x + 180) % 360 - 180 if f in ANGLES else x)
            x, r = x[~np.isnan(x)], got[f"{a}_{b}", f]
            want = (x.min(), x.mean(), x.std(), np.median(x), np.quantile(x, 0.95), x.max()) if len(x) else (None,) * 6
            assert r.n == len(x) and tuple(r)[3:] == (pytest.approx(want) if len(x) else want)


def test_code_of_differences_is_compiled(spark, sf):
    """The JVM leaves methods of more than 8,000 bytes to its interpreter."""
    from seqloom.plans.registry import QUERIES

    s = spark.newSession()
    s.conf.set("spark.sql.adaptive.enabled", "false")
    plan = QUERIES["candidate_differences"](s, sf)._jdf.queryExecution().executedPlan()
    code = s._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
    assert 0 < max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)) < 8000
