"""Angles, boxes and point sets.  Boxes are half open: x2 and y2 are outside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap_180(a: Column) -> Column:
    """The angle in [-180, 180); values next to 0 are 0."""
    x = F.pmod(a + 180.0, F.lit(360.0)) - 180.0
    return F.when(F.abs(x) < 1e-12, 0.0).otherwise(x)


def circular_difference(a: Column, b: Column) -> Column:
    return F.abs(wrap_180(a - b))


def centered(a: Column) -> Column:
    """An angle around 180 as one around 0."""
    return wrap_180(a - 180.0)


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("long").alias("x1"), y1.cast("long").alias("y1"), x2.cast("long").alias("x2"), y2.cast("long").alias("y2"))


def width(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0))


def height(b: Column) -> Column:
    return F.greatest(b["y2"] - b["y1"], F.lit(0))


def area(b: Column) -> Column:
    return width(b) * height(b)


def is_valid(b: Column) -> Column:
    return (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def clip(b: Column, w: Column, h: Column) -> Column:
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0)), most)
    return box(inside(b["x1"], w), inside(b["y1"], h), inside(b["x2"], w), inside(b["y2"], h))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 without a union."""
    i = intersection(a, b)
    return F.coalesce(F.try_divide(i.cast("double"), (area(a) + area(b) - i).cast("double")), F.lit(0.0))


def raw_roi(b: Column, margin: Column) -> Column:
    """The box with a margin of its sides, rounded outwards."""
    dx, dy = width(b) * margin, height(b) * margin
    return box(F.floor(b["x1"] - dx), F.floor(b["y1"] - dy), F.ceil(b["x2"] + dx), F.ceil(b["y2"] + dy))


def clipping(raw: Column, roi: Column) -> Column:
    """Whether clipping changed a box, and which share of it is lost."""
    lost = 1.0 - F.coalesce(F.try_divide(area(roi).cast("double"), area(raw).cast("double")), F.lit(0.0))
    return F.struct((raw != roi).alias("clipped"), lost.alias("clipped_fraction"))


def expand_roi(b: Column, margin: float, w: Column, h: Column) -> Column:
    """The box with a margin of its sides, clipped to the frame: roi, clipped, clipped_fraction."""
    raw = raw_roi(b, F.lit(margin))
    roi = clip(raw, w, h)
    c = clipping(raw, roi)
    return F.struct(roi.alias("roi"), c["clipped"].alias("clipped"), c["clipped_fraction"].alias("clipped_fraction"))


def square_roi(b: Column, margin: float) -> Column:
    """A square around the box's middle, its side the larger one with a margin on both ends."""
    side = F.ceil(F.greatest(width(b), height(b)) * (1.0 + 2.0 * margin)).cast("long")
    x = F.floor((b["x1"] + b["x2"]) / 2.0 - side / 2.0).cast("long")
    y = F.floor((b["y1"] + b["y2"]) / 2.0 - side / 2.0).cast("long")
    return box(x, y, x + side, y + side)


def crop_geometry(b: Column, roi: Column, w: Column, h: Column) -> Column:
    """Padding a crop needs on each side, its share of the crop, and the box's shares."""
    pad = lambda v: F.greatest(v, F.lit(0)).cast("long")
    shown = clip(roi, w, h)
    return F.struct(
        pad(-roi["x1"]).alias("left"),
        pad(-roi["y1"]).alias("top"),
        pad(roi["x2"] - w).alias("right"),
        pad(roi["y2"] - h).alias("bottom"),
        (1.0 - F.try_divide(area(shown).cast("double"), area(roi).cast("double"))).alias("padding_fraction"),
        F.try_divide(area(b).cast("double"), area(roi).cast("double")).alias("area_fraction"),
        F.try_divide(width(b).cast("double"), width(roi).cast("double")).alias("width_fraction"),
        F.try_divide(height(b).cast("double"), height(roi).cast("double")).alias("height_fraction"),
    )


def distortion(b: Column) -> Column:
    """The longer side over the shorter; null for a box without area."""
    w, h = width(b).cast("double"), height(b).cast("double")
    return F.try_divide(F.greatest(w, h), F.least(w, h))


def distance(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def span_ratio(verticals: list[tuple[Column, Column]], across: tuple[Column, Column], eps: float = 1e-6) -> Column:
    """Sum of vertical distances over n times the horizontal one (an eye's or mouth's aspect
    ratio); null for a span of at most ``eps`` or a point that is not finite."""
    top = sum((distance(*v) for v in verticals[1:]), distance(*verticals[0]))
    base = distance(*across)
    ratio = F.try_divide(top, base * float(len(verticals)))
    return F.when((base > eps) & ~F.isnan(ratio) & (F.abs(ratio) < float("inf")), ratio)


def eye_ratio(points: Column) -> Column:
    """Six points in order: two verticals over twice the width."""
    p = [points[i] for i in range(6)]
    return span_ratio([(p[1], p[5]), (p[2], p[4])], (p[0], p[3]))


def mouth_ratio(points: Column) -> Column:
    """Eight inner mouth points: three verticals; the width counts twice."""
    p = [points[i] for i in range(8)]
    return span_ratio([(p[1], p[7]), (p[2], p[6]), (p[3], p[5])], (p[0], p[4])) * 1.5


def mean_point_distance(a: Column, b: Column, b_box: Column) -> Column:
    """Mean distance of matching points in units of the box's root area (1 at least)."""
    each = F.zip_with(a, b, distance)
    total = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    return F.try_divide(total, F.size(a).cast("double")) / F.greatest(F.sqrt(area(b_box).cast("double")), F.lit(1.0))


def valid_geometry(b: Column, points: Column, w: Column, h: Column, ear: Column, mar: Column, pose_valid: Column, tolerance: float, least_side: int, ear_range: tuple[float, float], mar_range: tuple[float, float]) -> Column:
    """Structural validity of a face: face_valid, landmark_valid, valid, suspicious (any), and the
    reasons in a fixed order.  ``points`` are 68 (x, y); ear and mar are null where they are
    invalid.  A point outside the frame by more than the tolerance is a failure, one outside
    the box only suspicious.  Points are made and gone through once a row: an array of one
    element holds what several rules look at, first the points, then their outermost coordinates."""

    def extremes(p: Column) -> Column:
        x, y = p["x"], p["y"]
        # Null if a coordinate is: nothing can be said to be no part of an array with nulls.
        numbers = F.coalesce((F.size(p) == 68) & ~F.array_contains(x, float("nan")) & ~F.array_contains(y, float("nan")), F.lit(False))
        return F.struct(numbers.alias("numbers"), F.array_min(x).alias("x1"), F.array_max(x).alias("x2"), F.array_min(y).alias("y1"), F.array_max(y).alias("y2"))

    found = F.transform(F.transform(F.array(points), extremes), lambda e: _valid_geometry(b, e, w, h, ear, mar, pose_valid, tolerance, least_side, ear_range, mar_range))
    return found[0]


def _valid_geometry(b: Column, e: Column, w: Column, h: Column, ear: Column, mar: Column, pose_valid: Column, tolerance: float, least_side: int, ear_range: tuple[float, float], mar_range: tuple[float, float]) -> Column:
    """``valid_geometry`` from the outermost coordinates of the points."""
    face = is_valid(b) & (b["x1"] < w) & (b["y1"] < h)
    bounded = lambda v: F.abs(v) < float("inf")
    shaped = F.coalesce(e["numbers"] & bounded(e["x1"]) & bounded(e["x2"]) & bounded(e["y1"]) & bounded(e["y2"]), F.lit(False))
    outside = lambda x1, y1, x2, y2: (e["x1"] < x1) | (e["x2"] > x2) | (e["y1"] < y1) | (e["y2"] > y2)
    beyond = shaped & outside(-w * tolerance, -h * tolerance, w * (1 + tolerance), h * (1 + tolerance))
    off_box = shaped & outside(b["x1"], b["y1"], b["x2"], b["y2"])
    landmark = shaped & ~beyond
    odd = lambda v, r: v.isNotNull() & ~v.between(*r)
    named = lambda *pairs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))
    suspicious = named((beyond, "LANDMARK_OUTSIDE_FRAME"), (off_box, "LANDMARK_OUTSIDE_BBOX"), (F.least(width(b), height(b)) < least_side, "SUSPICIOUS_BBOX"), (odd(ear, ear_range), "SUSPICIOUS_EAR_EXTREME"), (odd(mar, mar_range), "SUSPICIOUS_MAR_EXTREME"))
    failures = named((~face, "INVALID_BBOX"), (~shaped, "INVALID_LANDMARKS"), (beyond, "LANDMARK_OUTSIDE_FRAME_TOLERANCE"), (ear.isNull(), "EAR_INVALID"), (mar.isNull(), "MAR_INVALID"), (~pose_valid, "HEAD_POSE_INVALID"))
    valid = face & landmark & ear.isNotNull() & mar.isNotNull() & pose_valid
    return F.struct(face.alias("face_valid"), landmark.alias("landmark_valid"), valid.alias("valid"), (F.size(suspicious) > 0).alias("suspicious"), suspicious.alias("suspicious_reasons"), failures.alias("failure_reasons"))


def padding_color(rgb_mean: tuple[float, float, float] = (0.485, 0.456, 0.406)) -> tuple[int, int, int]:
    """A mean color as 8-bit values (halves to even) in BGR order."""
    r, g, b = (round(x * 255) for x in rgb_mean)
    return b, g, r


def resize_rule(w: Column, h: Column, size: int) -> Column:
    """AREA if both sides shrink (or stay), LINEAR if one grows."""
    return F.when((w >= size) & (h >= size), "AREA").otherwise("LINEAR")
