"""Boxes, margins, crops and angles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import geometry as G
from seqloom.functions.scalars import two_by_two
from seqloom.operators.distribution import summary_columns

from . import twins as T
from ._register import query

MARGINS = (0.0, 0.05, 0.1, 0.2)
WIDTH, HEIGHT = 640, 480


def _frame():
    return F.lit(WIDTH).cast("long"), F.lit(HEIGHT).cast("long")


_INTER = "(greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0))"


@query(f"""WITH {T.BOXES}, i AS (SELECT l_orderkey, l_linenumber, {_INTER} AS i, w * h AS a FROM boxes) SELECT l_orderkey, l_linenumber, round(coalesce(i / nullif(2 * a - i, 0)::DOUBLE, 0), 9) AS iou FROM i""")
def box_iou(spark: SparkSession, d: str) -> DataFrame:
    return T.boxes(spark, d).select("l_orderkey", "l_linenumber", F.round(G.iou(F.col("a"), F.col("b")), 9).alias("iou"))


def _roi(m: float) -> str:
    return f"""SELECT l_orderkey, l_linenumber, {m} AS margin, w, h, ax1, ay1, ax2, ay2, CAST(floor(ax1 - w * {m}::DOUBLE) AS BIGINT) AS x1, CAST(floor(ay1 - h * {m}::DOUBLE) AS BIGINT) AS y1, CAST(ceil(ax2 + w * {m}::DOUBLE) AS BIGINT) AS x2, CAST(ceil(ay2 + h * {m}::DOUBLE) AS BIGINT) AS y2 FROM boxes"""


_ROIS = f"""rois AS ({' UNION ALL '.join(_roi(m) for m in MARGINS)}),
clipped AS (SELECT *, least(greatest(x1, 0), 640) AS cx1, least(greatest(y1, 0), 480) AS cy1, least(greatest(x2, 0), 640) AS cx2, least(greatest(y2, 0), 480) AS cy2 FROM rois),
lost AS (SELECT *, cx1 <> x1 OR cy1 <> y1 OR cx2 <> x2 OR cy2 <> y2 AS clipped, 1.0::DOUBLE - greatest(cx2 - cx1, 0) * greatest(cy2 - cy1, 0) / ((x2 - x1) * (y2 - y1))::DOUBLE AS fraction FROM clipped)"""


def rois(spark: SparkSession, d: str) -> DataFrame:
    """Every box with every margin; steps are columns of their own, so none is computed twice."""
    made = T.boxes(spark, d).select("l_orderkey", "l_linenumber", "a", F.explode(F.array(*[F.lit(m) for m in MARGINS])).alias("margin"))
    made = made.withColumn("raw", G.raw_roi(F.col("a"), F.col("margin"))).withColumn("roi", G.clip(F.col("raw"), *_frame()))
    return made.select("l_orderkey", "l_linenumber", "margin", "roi", G.clipping(F.col("raw"), F.col("roi")).alias("c")).select("l_orderkey", "l_linenumber", "margin", "roi", "c.*")


@query(f"""WITH {T.BOXES}, {_ROIS} SELECT l_orderkey, l_linenumber, margin::DOUBLE AS margin, cx1 AS x1, cy1 AS y1, cx2 AS x2, cy2 AS y2, clipped, round(fraction, 9) AS clipped_fraction FROM lost""")
def roi_margins(spark: SparkSession, d: str) -> DataFrame:
    return rois(spark, d).select("l_orderkey", "l_linenumber", "margin", "roi.x1", "roi.y1", "roi.x2", "roi.y2", "clipped", F.round("clipped_fraction", 9).alias("clipped_fraction"))


@query(f"""WITH {T.BOXES}, {_ROIS} SELECT margin::DOUBLE AS margin, count(*) AS n, count(*) FILTER (clipped) AS n_clipped, round(avg(fraction), 9) AS mean, round(quantile_cont(fraction, 0.95), 9) AS p95, round(max(fraction), 9) AS max FROM lost GROUP BY margin""")
def candidate_summary(spark: SparkSession, d: str) -> DataFrame:
    g = rois(spark, d).groupBy("margin").agg(F.count_if("clipped").alias("n_clipped"), *summary_columns(F.col("clipped_fraction"), (95,)))
    return g.select("margin", "n", "n_clipped", F.round("mean", 9).alias("mean"), F.round("p95", 9).alias("p95"), F.round("max", 9).alias("max"))


_SQUARE = f"""sq AS (SELECT *, CAST(ceil(greatest(w, h) * 1.2::DOUBLE) AS BIGINT) AS side FROM boxes),
s AS (SELECT *, CAST(floor((ax1 + ax2) / 2.0::DOUBLE - side / 2.0::DOUBLE) AS BIGINT) AS x1, CAST(floor((ay1 + ay2) / 2.0::DOUBLE - side / 2.0::DOUBLE) AS BIGINT) AS y1 FROM sq),
k AS (SELECT *, greatest(-x1, 0) AS "left", greatest(-y1, 0) AS top, greatest(x1 + side - 640, 0) AS "right", greatest(y1 + side - 480, 0) AS bottom,
  1.0::DOUBLE - greatest(least(x1 + side, 640) - least(greatest(x1, 0), 640), 0) * greatest(least(y1 + side, 480) - least(greatest(y1, 0), 480), 0) / (side * side)::DOUBLE AS padding_fraction, w * h / (side * side)::DOUBLE AS area_fraction FROM s)"""


@query(f"""WITH {T.BOXES}, {_SQUARE} SELECT l_orderkey, l_linenumber, side, "left", top, "right", bottom, round(padding_fraction, 9) AS padding_fraction, round(area_fraction, 9) AS area_fraction FROM k""")
def square_crops(spark: SparkSession, d: str) -> DataFrame:
    s = T.boxes(spark, d).withColumn("roi", G.square_roi(F.col("a"), 0.1))
    g = s.select("l_orderkey", "l_linenumber", G.width(F.col("roi")).alias("side"), G.crop_geometry(F.col("a"), F.col("roi"), *_frame()).alias("c"))
    return g.select("l_orderkey", "l_linenumber", "side", "c.left", "c.top", "c.right", "c.bottom", F.round("c.padding_fraction", 9).alias("padding_fraction"), F.round("c.area_fraction", 9).alias("area_fraction"))


def _wrap(x: str) -> str:
    return f"((({x}) + 180 - 360 * floor((({x}) + 180) / 360.0::DOUBLE)) - 180)"


@query(f"""WITH {T.BOXES} SELECT l_orderkey, l_linenumber, {_wrap('angle')} AS wrapped, abs({_wrap('angle - 170')}) AS to_170, {_wrap('angle - 180')} AS centered FROM boxes""")
def angles(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("angle")
    return T.boxes(spark, d).select("l_orderkey", "l_linenumber", G.wrap_180(a).alias("wrapped"), G.circular_difference(a, F.lit(170.0)).alias("to_170"), G.centered(a).alias("centered"))


@query(f"""WITH {T.BOXES}, l AS (SELECT l_orderkey, angle, lag(angle) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, angle) AS p FROM boxes), s AS (SELECT abs({_wrap('angle - p')}) AS v FROM l WHERE p IS NOT NULL)
SELECT count(*) AS n, round(avg(v), 6) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.95) AS p95, max(v) AS max FROM s""")
def adjacent_turns(spark: SparkSession, d: str) -> DataFrame:
    p = F.lag("angle").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "angle"))
    s = T.boxes(spark, d).withColumn("p", p).where("p IS NOT NULL").withColumn("v", G.circular_difference(F.col("angle"), F.col("p")))
    g = s.agg(*summary_columns(F.col("v"), (50, 95)))
    return g.select("n", F.round("mean", 6).alias("mean"), "median", "p95", "max")


@query(f"""WITH {T.BOXES} SELECT l_orderkey, max(w * h) AS area, arg_min(l_linenumber, -(w * h) * 1000 + l_linenumber) AS first_line FROM boxes GROUP BY l_orderkey""")
def largest_boxes(spark: SparkSession, d: str) -> DataFrame:
    """The largest valid box of each group; the first of equal ones."""
    b = T.boxes(spark, d).where(G.is_valid(F.col("a")))
    return b.groupBy("l_orderkey").agg(F.max(G.area(F.col("a"))).alias("area"), F.max_by("l_linenumber", F.struct(G.area(F.col("a")), -F.col("l_linenumber"))).alias("first_line"))


@query(f"""WITH {T.BOXES} SELECT CASE WHEN greatest(w / h::DOUBLE, h / w::DOUBLE) < 1.5 THEN 'low' WHEN greatest(w / h::DOUBLE, h / w::DOUBLE) < 3 THEN 'mid' ELSE 'high' END AS distortion, count(*) AS n, round(avg(greatest(w / h::DOUBLE, h / w::DOUBLE)), 6) AS mean FROM boxes GROUP BY 1""")
def distortion_levels(spark: SparkSession, d: str) -> DataFrame:
    x = T.boxes(spark, d).withColumn("r", G.distortion(F.col("a")))
    level = F.when(F.col("r") < 1.5, "low").when(F.col("r") < 3, "mid").otherwise("high")
    return x.groupBy(level.alias("distortion")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean"))


@query("""WITH p AS (SELECT p_partkey, (p_size % 7)::DOUBLE AS s, (p_partkey % 11)::DOUBLE AS t FROM part), g AS (SELECT p_partkey, sqrt(s * s + (t + 1) * (t + 1)) AS v1, sqrt(t * t + 4) AS v2, s AS base FROM p)
SELECT p_partkey, CASE WHEN base > 1e-6 THEN round((v1 + v2) / (2 * base), 6) END AS eye_ratio FROM g""")
def eye_ratios(spark: SparkSession, d: str) -> DataFrame:
    from seqloom.sources.readers import table

    s, t = F.pmod("p_size", F.lit(7)).cast("double"), F.pmod("p_partkey", F.lit(11)).cast("double")
    at = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    points = F.array(at(0, 0), at(0, 0), at(0, 0), at(s, 0), at(t, 2), at(s, t + 1))
    return table(spark, d, "part").select("p_partkey", F.round(G.eye_ratio(points), 6).alias("eye_ratio"))


@query(f"""WITH {T.BOXES}, o AS (SELECT w * h >= 4000 AS a, abs({_wrap('angle')}) < 90 AS b FROM boxes) SELECT CASE WHEN a AND b THEN 'both_success' WHEN a THEN 'first_only' WHEN b THEN 'second_only' ELSE 'both_failed' END AS outcome, count(*) AS n FROM o GROUP BY 1""")
def outcome_matrix(spark: SparkSession, d: str) -> DataFrame:
    o = two_by_two(G.area(F.col("a")) >= 4000, F.abs(G.wrap_180(F.col("angle"))) < 90, "both_success", "first_only", "second_only", "both_failed")
    return T.boxes(spark, d).groupBy(o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
