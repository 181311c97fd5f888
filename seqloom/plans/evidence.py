"""Named differences with what they rest on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import vectors as V
from seqloom.operators import evidence as E
from seqloom.operators.distribution import long_form, summarize
from seqloom.operators.statistics import dimension_shift, mean_vector_comparison
from seqloom.sources.readers import table

from . import rules as R
from ._register import query
from .reviews import _PAIR, _pairs

_TEXTS = lambda *c: [F.array_join(x, ",").alias(x) for x in c]
#: Ranges of each metric by model and split, for all labels (null) and each.
_RANGES = f"""{R._MODELS}, lm AS (SELECT model, split, CAST(label AS VARCHAR) AS label, u.metric, u.v FROM cm, LATERAL (VALUES ('m1', m1), ('m2', m2)) AS u(metric, v)),
rg AS (SELECT model, split, x.label, metric, quantile_cont(v, 0.1) AS p10, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.9) AS p90 FROM (SELECT * FROM lm UNION ALL SELECT model, split, NULL, metric, v FROM lm) AS x GROUP BY ALL),
mo AS (SELECT v.model, v.label, list(v.metric ORDER BY v.metric) FILTER (v.median < t.p10 OR v.median > t.p90) AS o FROM rg v JOIN rg t ON v.model = t.model AND v.metric = t.metric AND v.label IS NOT DISTINCT FROM t.label AND v.split = 'val' AND t.split = 'train' GROUP BY ALL),
mx AS (SELECT model, label, coalesce(len(o), 0) AS n, coalesce(array_to_string(o, ','), '') AS outside FROM mo)"""


def _metric_ranges(m: DataFrame) -> DataFrame:
    x = long_form(m.select("model", "split", F.col("label").cast("string").alias("label"), "m1", "m2"), ["model", "split", "label"], ["m1", "m2"])
    x = x.unionByName(x.withColumn("label", F.lit(None).cast("string")))
    return summarize(x, ["model", "split", "label", "metric"], F.col("value"), (10, 50, 90))


@query(f"""WITH {_RANGES}, dim AS (SELECT model, split, i, avg(v[i]) AS m, stddev_pop(v[i]) AS s FROM hm, (SELECT unnest(range(1, 33)) AS i) GROUP BY ALL),
ds AS (SELECT v.model, quantile_cont(abs(v.m - t.m) / (t.s + 1e-12), 0.95) >= 0.5 AS l, sum(v.m * t.m) / (sqrt(sum(v.m * v.m)) * sqrt(sum(t.m * t.m))) < 0.99 AS c FROM dim v JOIN dim t ON v.model = t.model AND v.i = t.i AND v.split = 'val' AND t.split = 'train' GROUP BY v.model),
e AS (SELECT mx.model, label, outside, l AS dimension_large, c AS center_large, n + l::INTEGER + c::INTEGER AS s FROM mx JOIN ds ON ds.model = mx.model WHERE label IS NULL), p AS (SELECT model, label, outside FROM mx WHERE label IS NOT NULL AND n >= 2),
k AS (SELECT count(*) FILTER (s >= 2) AS flagged, max(s) > 0 AS hint, (SELECT count(*) FROM p) > 0 AS cond FROM e), r AS (SELECT CASE WHEN flagged = 2 THEN 'POSSIBLE_FEATURE_DISTRIBUTION_SHIFT' WHEN flagged = 1 THEN 'BACKBONE_SPECIFIC_SHIFT' WHEN cond THEN 'LABEL_CONDITIONAL_SHIFT' WHEN hint THEN 'MIXED' ELSE 'NO_OBVIOUS_FEATURE_DISTRIBUTION_SHIFT' END AS result FROM k)
SELECT model, label, outside, dimension_large, center_large, s >= 2 AS flag, result FROM e, r UNION ALL SELECT model, label, outside, NULL, NULL, true, result FROM p, r""")
def feature_shift_evidence(spark: SparkSession, d: str) -> DataFrame:
    h, m = R._clip_metrics(spark, d)
    shifts = None
    for model in ("a", "b"):
        s = dimension_shift(h.where(F.col("model") == model), "v", "split", "train", "val")
        one = mean_vector_comparison(s).crossJoin(s.agg(F.percentile("shift", 0.95).alias("p95"))).select(F.lit(model).alias("model"), "p95", "cosine")
        shifts = one if shifts is None else shifts.unionByName(one)
    e = E.feature_shift_evidence(_metric_ranges(m), shifts, models=2)
    return e.select("model", "label", *_TEXTS("outside"), "dimension_large", "center_large", "flag", "result")


_SIDE = "SELECT a.model, a.split, list(a.metric ORDER BY a.metric) FILTER (a.median < b.p10 OR a.median > b.p90) AS o FROM rg a JOIN rg b ON a.model = b.model AND a.split = b.split AND a.metric = b.metric AND a.label = '{}' AND b.label = '{}' GROUP BY ALL"


@query(f"""WITH {_RANGES}, st AS (SELECT model, split, v, lag(v) OVER (PARTITION BY model, clip ORDER BY slot) AS p FROM hm), nd AS (SELECT model, split, avg(({R._COS} >= 0.99)::INTEGER) AS rate FROM st WHERE p IS NOT NULL GROUP BY ALL),
x AS ({_SIDE.format('true', 'false')}), y AS ({_SIDE.format('false', 'true')}),
e AS (SELECT 'split' AS criterion, model, NULL AS split, outside, '' AS other_outside, n >= 2 AS flag FROM mx WHERE label IS NULL UNION ALL SELECT 'redundancy', model, NULL, '', '', min(rate) >= 0.8 FROM nd GROUP BY model
UNION ALL SELECT 'label', x.model, x.split, coalesce(array_to_string(x.o, ','), ''), coalesce(array_to_string(y.o, ','), ''), len(list_distinct(list_concat(coalesce(x.o, []), coalesce(y.o, [])))) >= 2 FROM x JOIN y ON x.model = y.model AND x.split = y.split),
k AS (SELECT bool_or(flag) FILTER (criterion = 'split') AS a, bool_or(flag) FILTER (criterion = 'redundancy') AS b, bool_or(flag) FILTER (criterion = 'label') AS c FROM e)
SELECT e.*, CASE WHEN a::INTEGER + b::INTEGER + c::INTEGER > 1 THEN 'MIXED' WHEN a THEN 'POSSIBLE_TEMPORAL_SPLIT_SHIFT' WHEN b THEN 'POSSIBLE_TEMPORAL_REDUNDANCY' WHEN c THEN 'LABEL_CONDITIONAL_TEMPORAL_PATTERN' ELSE 'NO_OBVIOUS_TEMPORAL_SHIFT' END AS result FROM e, k""")
def temporal_evidence(spark: SparkSession, d: str) -> DataFrame:
    h, m = R._clip_metrics(spark, d)
    step = h.withColumn("p", F.lag("v").over(Window.partitionBy("model", "clip").orderBy("slot"))).where("p IS NOT NULL")
    near = step.groupBy("model", "split").agg(F.avg((V.cosine(F.col("v"), F.col("p")) >= 0.99).cast("double")).alias("rate"))
    e = E.temporal_evidence(_metric_ranges(m), near, ("false", "true"))
    return e.select("criterion", "model", "split", *_TEXTS("outside", "other_outside"), "flag", "result")


@query(f"""WITH {_PAIR}, n AS (SELECT count(*) AS n, count(*) FILTER (NOT correct_a AND NOT correct_b) AS both_incorrect, count(*) FILTER (NOT correct_a AND correct_b) AS a_only_incorrect, count(*) FILTER (correct_a AND NOT correct_b) AS b_only_incorrect, sum(loss_a) AS sa, sum(loss_b) AS sb FROM pair),
a AS (SELECT video_id, loss_a, row_number() OVER (ORDER BY loss_a DESC, video_id) AS r FROM pair), b AS (SELECT video_id, loss_b, row_number() OVER (ORDER BY loss_b DESC, video_id) AS r FROM pair),
k AS (SELECT (SELECT sum(loss_a) FROM a WHERE r <= ceil(n * 0.1)) / sa AS x, (SELECT sum(loss_b) FROM b WHERE r <= ceil(n * 0.1)) / sb AS y, (SELECT count(*) FROM a JOIN b ON a.video_id = b.video_id AND a.r <= 20 AND b.r <= 20) AS both_high_loss, both_incorrect, a_only_incorrect, b_only_incorrect FROM n),
f AS (SELECT *, greatest(x, y) >= 0.5 AS concentrated, both_high_loss >= 10 AS shared, a_only_incorrect + b_only_incorrect > both_incorrect AS model_specific FROM k)
SELECT both_incorrect, a_only_incorrect, b_only_incorrect, both_high_loss, round(x, 9) AS share_a, round(y, 9) AS share_b, concentrated, shared, model_specific, CASE WHEN concentrated THEN 'LOSS_CONCENTRATED_IN_FEW_SAMPLES' WHEN shared AND model_specific THEN 'MIXED' WHEN shared THEN 'SHARED_BACKBONE_HARD_SAMPLES' WHEN model_specific THEN 'BACKBONE_SPECIFIC_HARD_SAMPLES' ELSE 'BROAD_VALIDATION_DIFFICULTY' END AS result FROM f""")
def loss_evidence(spark: SparkSession, d: str) -> DataFrame:
    e = E.loss_evidence(_pairs(spark, d), "video_id", (("a", "loss_a", "correct_a"), ("b", "loss_b", "correct_b")))
    return e.withColumns({c: F.round(c, 9) for c in ("share_a", "share_b")})


_ANSWERS = {
    "face_visibility_problem": "l_linenumber + l_partkey % 3 <= 4", "major_occlusion": "l_linenumber + l_suppkey % 5 <= 3", "lighting_issue": "l_quantity > 25", "extreme_head_pose": "l_linenumber <= 2 AND l_returnflag <> 'R'", "framing_issue": "l_discount > 0.02",
    "brief_cue": "l_linenumber + l_orderkey % 4 <= 3 AND l_returnflag = 'A'", "label_concern": "l_tax > 0.03",
}
_QUALITY = tuple(_ANSWERS)[:5]
_HOLDS = {c: f"avg(({e})::INTEGER) FILTER (l_linenumber <= 3) >= 0.5 AND avg(({e})::INTEGER) FILTER (l_linenumber <= 3) - avg(({e})::INTEGER) FILTER (NOT l_linenumber <= 3) >= 0.2" for c, e in _ANSWERS.items()}
_SOME = "list_filter([{}], lambda x: x IS NOT NULL)"


@query(f"""WITH r AS (SELECT l_returnflag, {', '.join(f'{e} AS {c}' for c, e in _HOLDS.items())} FROM lineitem GROUP BY 1), q AS (SELECT *, {_SOME.format(', '.join(f"CASE WHEN {c} THEN '{c}' END" for c in _QUALITY))} AS f FROM r),
m AS (SELECT l_returnflag, f, {_SOME.format("CASE WHEN len(f) > 0 THEN 'VISUAL_DATA_QUALITY_PATTERN' END, CASE WHEN brief_cue THEN 'BRIEF_OR_AMBIGUOUS_TEMPORAL_CUES' END, CASE WHEN label_concern THEN 'POSSIBLE_LABEL_AMBIGUITY' END")} AS p FROM q)
SELECT l_returnflag, array_to_string(f, ',') AS repeated_quality_fields, array_to_string(p, ',') AS matched_patterns, CASE len(p) WHEN 0 THEN 'NO_OBVIOUS_VISUAL_EXPLANATION' WHEN 1 THEN p[1] ELSE 'MIXED' END AS result FROM m""")
def review_evidence(spark: SparkSession, d: str) -> DataFrame:
    decimal = lambda e: e.replace("0.02", "0.02D").replace("0.03", "0.03D")
    answers = table(spark, d, "lineitem").selectExpr("l_returnflag", "l_linenumber <= 3 AS hard", *[f"{decimal(e)} AS {c}" for c, e in _ANSWERS.items()])
    return E.review_evidence(answers, ["l_returnflag"], "hard", _QUALITY, "brief_cue", "label_concern").select("l_returnflag", *_TEXTS("repeated_quality_fields", "matched_patterns"), "result")
