import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import geometry as G
from seqloom.functions import hashing as H
from seqloom.functions import scalars as S
from seqloom.functions import vectors as V


@pytest.fixture(scope="module")
def at(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first().x


def box(*v):
    return G.box(*[F.lit(x) for x in v])


def test_angles(at):
    for a, b, want in ((179, -179, 2), (-179, 179, 2), (10, 20, 10), (-170, 170, 20), (0, 180, 180)):
        assert at(G.circular_difference(F.lit(float(a)), F.lit(float(b)))) == want
    assert [at(G.centered(F.lit(float(a)))) for a in (180, 179, -179)] == [0, -1, 1]
    assert at(G.wrap_180(F.lit(540.0))) == -180 and at(G.wrap_180(F.lit(-190.0))) == 170


@pytest.mark.parametrize("b,want,clipped", [
    ((200, 150, 400, 350), (190, 140, 410, 360), False), ((5, 150, 205, 350), (0, 140, 215, 360), True), ((200, 5, 400, 205), (190, 0, 410, 215), True),
    ((435, 150, 635, 350), (425, 140, 640, 360), True), ((200, 275, 400, 475), (190, 265, 410, 480), True),
])
def test_margins(at, b, want, clipped):
    r = at(G.expand_roi(box(*b), 0.05, F.lit(640), F.lit(480)))
    assert tuple(r.roi) == want and r.clipped is clipped


def test_margin_fractions_and_squares(at):
    r = at(G.expand_roi(box(100, 100, 109, 201), 0.05, F.lit(640), F.lit(480)))
    assert tuple(r.roi) == (99, 94, 110, 207) and not r.clipped
    r = at(G.expand_roi(box(0, 50, 100, 150), 0.10, F.lit(200), F.lit(200)))
    assert tuple(r.roi) == (0, 40, 110, 160) and r.clipped_fraction == pytest.approx(1 - 110 * 120 / 120**2)
    for m, want in ((0.0, (50, 50, 350, 350)), (0.1, (20, 20, 380, 380)), (0.2, (-10, -10, 410, 410))):
        assert tuple(at(G.square_roi(box(100, 50, 300, 350), m))) == want
    c = at(G.crop_geometry(box(0, 0, 100, 100), G.square_roi(box(0, 0, 100, 100), 0.1), F.lit(200), F.lit(200)))
    assert (c.left, c.top, c.right, c.bottom) == (10, 10, 0, 0) and c.padding_fraction == pytest.approx(1 - 110**2 / 120**2)


def test_boxes_and_ratios(at):
    assert at(G.iou(box(0, 0, 2, 2), box(1, 1, 3, 3))) == pytest.approx(1 / 7) and at(G.iou(box(0, 0, 0, 0), box(0, 0, 0, 0))) == 0.0
    assert at(G.distortion(box(0, 0, 10, 5))) == 2.0
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    eye = [(0, 0), (1, 1), (2, 1), (3, 0), (2, -1), (1, -1)]
    assert at(G.eye_ratio(F.array(*[point(*p) for p in eye]))) == pytest.approx(4 / 6)
    assert at(G.eye_ratio(F.array(*[point(1, 1)] * 6))) is None
    assert at(G.eye_ratio(F.array(point(float("nan"), 0), *[point(*p) for p in eye[1:]]))) is None
    mouth = [(0, 0), (1, 1), (2, 1), (3, 1), (4, 0), (3, -1), (2, -1), (1, -1)]
    assert at(G.mouth_ratio(F.array(*[point(*p) for p in mouth]))) == pytest.approx(6 / 8)


def test_scalars(at):
    assert at(S.finite(F.lit("nan"))) is None and at(S.finite(F.lit("inf"))) is None and at(S.finite(F.lit(""))) is None and at(S.finite(F.lit("2.5"))) == 2.5
    assert at(S.is_infinite(F.lit("-inf"))) and not at(S.is_infinite(F.lit("x")))
    assert at(S.is_true_strict(F.lit("True"))) is True
    with pytest.raises(Exception, match="not a boolean"):
        at(S.is_true_strict(F.lit("yes")))
    assert at(S.review_flag(F.lit("N.A."))) is None
    assert at(S.normal_name(F.lit(" Video-ID  x "))) == "video_id_x" and at(S.normal_reference(F.lit(r" ./A\B.mp4"))) == "a/b.mp4"
    assert at(S.safe_path(F.lit("a/b"))) and not at(S.safe_path(F.lit("a/../b"))) and not at(S.safe_path(F.lit("/a"))) and at(S.safe_path(F.lit("a..b/c")))
    for i, n, want in ((447, 454, (27, 15, 16, False)), (453, 454, (28, 5, 6, True)), (52964, 52965, (3310, 4, 5, True))):
        assert tuple(at(S.batch_position(F.lit(i), F.lit(n), 16))) == want


def test_vectors(at):
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert at(V.cosine(arr(1, 0), arr(0, 0))) is None and at(V.cosine(arr(1, 1), arr(2, 2))) == pytest.approx(1)
    d = at(V.difference_stats(arr(1, 2, 3), arr(1, 2, 3.0002)))
    assert d.failed == 1 and [t["pass"] for t in d.tolerances] == [False, False, True]
    u = at(V.difference_stats(arr(0, 4, -2), arr(1e-38, 4, -1)))
    assert u.max_relative == pytest.approx(1e-38 / 1.1754943508222875e-38) and u.nonzero == 2 and u.failed == 1
    left = at(V.difference_stats(arr(100, 1), arr(50, 1)))
    assert left.max_relative == pytest.approx(0.5) and left.max_abs == 50 and left.mean_abs == 25 and left.median_abs == 25
    odd = at(V.difference_stats(arr("nan", "inf", "inf"), arr("nan", "inf", 1)))
    assert odd.failed == 2 and not odd.exact and not odd.close
    none = at(V.difference_stats(F.array().cast("array<double>"), F.array().cast("array<double>")))
    assert none.max_abs == 0 and none.mean_abs is None and none.exact and none.close and none.failed == 0
    with pytest.raises(Exception, match="arrays of 2 and 3 elements"):
        at(V.difference_stats(arr(1, 2), arr(1, 2, 3)))
    assert d.nonzero == 1 and not d.close and not d.exact and d.max_abs == pytest.approx(2e-4)
    assert at(V.longest_true(F.array(*[F.lit(bool(x)) for x in (1, 1, 0, 1)]))) == 2
    assert at(V.pop_std(arr(1, 2, 3))) == pytest.approx(np.std([1, 2, 3]))
    assert tuple(at(V.bad_counts(arr("nan", "inf", 0, 1)))) == (1, 1, 1)


def test_hashes(spark):
    assert H.stable_hash({"b": 1, "a": "한"}) == H.stable_hash({"a": "한", "b": 1})
    d = spark.createDataFrame([(1, "a"), (2, None)], "o int, v string")
    h = lambda x: x.agg(H.relation_hash(F.col("o"), "o", "v").alias("h")).first().h
    assert h(d) == h(d.orderBy(F.desc("o"))) and h(d) != h(d.withColumn("v", F.lit("z")))
    bag = lambda x: x.agg(H.bag_hash("o", "v").alias("h")).first().h
    assert bag(d) == bag(d.repartition(3)) and bag(d) != bag(d.unionByName(d))
