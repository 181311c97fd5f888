"""Observed frames with faults in them: rules, scans, plans and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import frames as O
from seqloom.operators.resample import substitute
from seqloom.operators.sampling import top_k

from . import twins as T
from ._register import query

#: The fixture's columns as SQL that both sides read: frames of 100 slots, some with faults.
_CONTEXT = [int(i * 99 / 31 + 0.5) for i in range(32)]
_FIELDS = {
    "canonical_index": "slot",
    "target_timestamp_sec": "slot / 10.0D",
    "source_frame_index": "CASE WHEN video_id % 29 = 0 AND slot = 50 THEN 0 ELSE slot * 3 + video_id % 3 END",
    "decode_ok": "NOT (video_id % 31 = 0 AND slot = 7)",
    "source_index_in_range": "NOT (video_id % 31 = 0 AND slot = 8)",
    "yunet_success": "available",
    "landmark_success": "(available AND n_events % 3 <> 0) OR (video_id % 17 = 0 AND slot = 5)",
    "pose_success": "(available AND n_events % 3 = 1) OR (video_id % 37 = 0 AND slot = 6)",
    "context_selected": f"slot IN ({', '.join(map(str, _CONTEXT))})",
    "context_slot": f"CASE slot {' '.join(f'WHEN {s} THEN {i}' for i, s in enumerate(_CONTEXT))} END",
    "bbox_width": "CASE WHEN available THEN CASE WHEN video_id % 47 = 0 AND slot % 11 = 0 THEN 0 ELSE slot % 7 + 20 END END",
    "bbox_height": "30",
    "frame_width": "640",
    "frame_height": "480",
    "yunet_confidence": "CASE WHEN available THEN 0.9D END",
}
_MORE = {
    "context_crop_available": "(context_selected AND yunet_success AND n_events % 5 <> 0) OR (video_id % 19 = 0 AND slot = 0)",
    "ear": "CASE WHEN landmark_success AND NOT (video_id % 23 = 0 AND slot % 10 = 0) THEN max_value WHEN video_id % 41 = 0 AND slot = 9 THEN 1.0D END",
    "pitch_raw": "CASE WHEN video_id % 43 = 0 AND slot % 20 = 0 THEN INF WHEN pose_success THEN max_value * 10 WHEN video_id % 61 = 0 AND slot = 3 THEN 2000000.0D END",
}
_LAST = {"mar": "ear * 0.5D", "pitch_centered_candidate": "pitch_raw - 180.0D", "yaw": "pitch_raw - 5.0D", "roll": "pitch_raw / 2.0D"}
_KEEP = ["video_id", "split", "label", "n_events"]


def _duck(e: str) -> str:
    import re

    return re.sub(r"(\d\.\d+)D", r"\1::DOUBLE", e).replace("INF", "'inf'::DOUBLE")


def _step(source: str, fields: dict[str, str], name: str) -> str:
    return f"{name} AS (SELECT *, {', '.join(f'{_duck(e)} AS {c}' for c, e in fields.items())} FROM {source})"


FRAMES = f"{T.USERS}, {T.frames_sql(100)}, {_step('frames', _FIELDS, 'c0')}, {_step('c0', _MORE, 'c1')}, {_step('c1', _LAST, 'c')}"


def canonical(spark: SparkSession, d: str) -> DataFrame:
    x = T.frames(spark, d, 100)
    for fields in (_FIELDS, _MORE, _LAST):
        x = x.withColumns({c: F.expr(e.replace("INF", "double('Infinity')")) for c, e in fields.items()})
    return x


_FIN = "({c} IS NOT NULL AND isfinite({c}))"
_fin = lambda c: _FIN.format(c=c)
_VALUES = ["ear", "mar", *O.POSE]
_POSES = " AND ".join(map(_fin, O.POSE))
_ANY_POSE = " OR ".join(map(_fin, O.POSE))
_ISSUES = [
    ("LANDMARK_SUCCESS_NONFINITE_EAR_MAR", f"landmark_success AND NOT ({_fin('ear')} AND {_fin('mar')})"),
    ("LANDMARK_FAILURE_FINITE_EAR_MAR", f"NOT landmark_success AND ({_fin('ear')} OR {_fin('mar')})"),
    ("POSE_SUCCESS_NONFINITE_VALUES", f"pose_success AND NOT ({_POSES})"),
    ("POSE_FAILURE_FINITE_VALUES", f"NOT pose_success AND ({_ANY_POSE})"),
    ("FEATURE_DEPENDENCY", "landmark_success AND NOT yunet_success OR pose_success AND NOT landmark_success"),
    ("CROP_DEPENDENCY", "context_crop_available AND (NOT context_selected OR NOT yunet_success)"),
    ("DECODE_OR_SOURCE_INDEX", "NOT decode_ok OR NOT source_index_in_range"),
    ("NUMERIC_INFINITY", " OR ".join(f"coalesce(isinf({c}), false)" for c in _VALUES)),
    ("NUMERIC_OVERFLOW_DIAGNOSTIC", " OR ".join(f"({_fin(c)} AND abs({c}) > 1000000)" for c in _VALUES)),
    ("INVALID_BBOX_OR_CONFIDENCE", "yunet_success AND (bbox_width IS NULL OR bbox_width <= 0 OR yunet_confidence IS NULL)"),
]


@query(f"WITH {FRAMES} " + " UNION ALL ".join(f"SELECT video_id, canonical_index, '{code}' AS rule FROM c WHERE {test}" for code, test in _ISSUES))
def frame_issues(spark: SparkSession, d: str) -> DataFrame:
    """Every fault of every frame."""
    return O.frame_issues(canonical(spark, d)).select("video_id", "canonical_index", "rule")


_MISS = lambda c: f"({c} IS NULL OR isnan({c}) OR isinf({c}))"
_BROKEN = f"""b AS (SELECT * FROM c WHERE NOT (video_id % 13 = 0 AND slot = 99)),
o AS (SELECT video_id, coalesce(source_frame_index < lag(source_frame_index) OVER (PARTITION BY video_id ORDER BY slot), false) AS falls FROM b),
per AS (SELECT video_id, count(*) AS n, count(*) FILTER (context_selected) AS sel, min(canonical_index) AS low, max(canonical_index) AS high, count(DISTINCT context_slot) AS slots, max(context_slot) AS top FROM b GROUP BY video_id)"""


@query(f"""WITH {FRAMES}, {_BROKEN},
e AS (SELECT video_id, 'CANONICAL_ROW_COUNT' AS error FROM per WHERE n <> 100 UNION ALL SELECT video_id, 'CANONICAL_INDEX' FROM per WHERE n <> 100 OR low <> 0 OR high <> 99
UNION ALL SELECT video_id, 'CONTEXT_SELECTION_COUNT' FROM per WHERE sel <> 32 UNION ALL SELECT video_id, 'CONTEXT_SLOT_INDEX' FROM per WHERE slots <> 32 OR top <> 31
UNION ALL SELECT DISTINCT video_id, 'SAMPLING_ORDER' FROM o WHERE falls
UNION ALL SELECT video_id, 'DEPENDENCY:' || slot FROM b WHERE landmark_success AND NOT yunet_success OR context_crop_available AND NOT yunet_success OR context_crop_available AND NOT context_selected
UNION ALL SELECT video_id, 'LANDMARK_MISSING:' || slot FROM b WHERE NOT landmark_success AND NOT ({_MISS('ear')} AND {_MISS('mar')})
UNION ALL SELECT video_id, 'POSE_MISSING:' || slot FROM b WHERE NOT pose_success AND NOT ({' AND '.join(map(_MISS, O.POSE))})
UNION ALL SELECT video_id, 'MARKER_HASH_MISSING' FROM per WHERE video_id % 7 = 0 UNION ALL SELECT video_id, 'MARKER_ROW_COUNT' FROM per WHERE video_id % 7 = 0 OR video_id % 13 = 0) SELECT video_id, error FROM e""")
def bundle_errors(spark: SparkSession, d: str) -> DataFrame:
    """Bundles of which some lack a frame, a marker, or order."""
    b = canonical(spark, d).where("NOT (video_id % 13 = 0 AND slot = 99)")
    markers = T.users(spark, d).where("video_id % 7 <> 0").select("video_id", F.lit("p").alias("policy_hash"), F.lit("r").alias("run_config_hash"), F.when(F.expr("video_id % 13 = 0"), 99).otherwise(100).alias("canonical_row_count"))
    return O.bundle_errors(b, markers)


@query(f"""WITH {FRAMES}, {_BROKEN}, m AS (SELECT video_id, CASE WHEN video_id % 59 = 0 THEN 'other' ELSE label END AS label, CASE WHEN video_id % 67 = 0 THEN 'q' ELSE 'p' END AS policy FROM users WHERE video_id % 53 <> 0 UNION ALL SELECT -1, 'pos', 'p'),
l AS (SELECT DISTINCT video_id, label FROM b), e AS (
SELECT per.video_id, 'UNKNOWN_VIDEO' AS error FROM per LEFT JOIN m USING (video_id) WHERE m.label IS NULL UNION ALL SELECT m.video_id, 'NO_FRAMES' FROM m LEFT JOIN per USING (video_id) WHERE per.n IS NULL
UNION ALL SELECT video_id, 'ROW_COUNT' FROM per WHERE n <> 100 UNION ALL SELECT video_id, 'INDEX' FROM per WHERE n <> 100 UNION ALL SELECT video_id, 'CONTEXT_SLOTS' FROM per WHERE slots <> 32
UNION ALL SELECT l.video_id, 'LABEL' FROM l JOIN m USING (video_id) WHERE l.label <> m.label UNION ALL SELECT DISTINCT video_id, 'ORDER' FROM o WHERE falls UNION ALL SELECT video_id, 'POLICY' FROM m WHERE policy <> 'p') SELECT video_id, error FROM e""")
def scan_errors(spark: SparkSession, d: str) -> DataFrame:
    """Frames against video metadata."""
    b = canonical(spark, d).where("NOT (video_id % 13 = 0 AND slot = 99)")
    m = T.users(spark, d).where("video_id % 53 <> 0").selectExpr("video_id", "CASE WHEN video_id % 59 = 0 THEN 'other' ELSE label END AS label", "CASE WHEN video_id % 67 = 0 THEN 'q' ELSE 'p' END AS policy_hash")
    m = m.unionByName(spark.sql("SELECT -1L AS video_id, 'pos' AS label, 'p' AS policy_hash"))
    return O.scan_errors(b, m, policy="p")


@query(f"""WITH {FRAMES} SELECT video_id, count(*) FILTER (yunet_success) AS yunet_success_count, count(*) FILTER (NOT yunet_success) AS yunet_failure_count, count(*) FILTER (landmark_success) AS landmark_success_count,
  count(*) FILTER (yunet_success) - count(*) FILTER (landmark_success) AS landmark_failure_count, count(*) FILTER ({_fin('ear')}) AS ear_valid_count, count(*) FILTER ({_fin('mar')}) AS mar_valid_count, count(*) FILTER (pose_success) AS pose_valid_count,
  count(*) FILTER (context_selected) AS context_selected_count, count(*) FILTER (context_crop_available) AS context_crop_available_count, count(*) FILTER (context_selected AND NOT context_crop_available) AS context_crop_missing_count,
  count(*) FILTER (decode_ok) AS decoded_slots, count(*) FILTER (twice) AS duplicate_source_index_count FROM (SELECT *, count(*) OVER (PARTITION BY video_id, source_frame_index) > 1 AS twice FROM c) GROUP BY video_id""")
def video_counters(spark: SparkSession, d: str) -> DataFrame:
    return O.video_counters(canonical(spark, d))


@query(f"""WITH {FRAMES}, i AS (SELECT *, slot - row_number() OVER (PARTITION BY video_id ORDER BY slot) AS island FROM c WHERE NOT yunet_success)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY min(slot))::INTEGER AS run_id, min(slot) AS start, max(slot) AS "end", count(*) AS length, min(target_timestamp_sec) AS start_timestamp_sec, max(target_timestamp_sec) AS end_timestamp_sec,
  min(slot) = 0 AS touches_clip_start, max(slot) = 99 AS touches_clip_end, count(*) FILTER (context_selected) AS context_slots_inside_run, count(*) FILTER (context_selected AND NOT context_crop_available) AS context_missing_slots_inside_run FROM i GROUP BY video_id, island""")
def run_table(spark: SparkSession, d: str) -> DataFrame:
    return O.run_table(canonical(spark, d))


@query(f"""WITH {FRAMES}, v AS (SELECT video_id, count(*) FILTER (NOT yunet_success) AS missing, count(*) FILTER (context_selected AND NOT context_crop_available) AS context FROM c GROUP BY video_id),
i AS (SELECT video_id, slot, slot - row_number() OVER (PARTITION BY video_id ORDER BY slot) AS island FROM c WHERE NOT yunet_success), r AS (SELECT video_id, min(slot) AS start, count(*) AS length FROM i GROUP BY video_id, island)
SELECT 'missing' AS ranking, video_id, 0 AS start, row_number() OVER (ORDER BY missing DESC, context DESC, video_id)::INTEGER AS rank FROM v QUALIFY rank <= 50
UNION ALL SELECT 'context', video_id, 0, row_number() OVER (ORDER BY context DESC, missing DESC, video_id)::INTEGER AS rank FROM v QUALIFY rank <= 50
UNION ALL SELECT 'runs', video_id, start, row_number() OVER (ORDER BY length DESC, video_id, start)::INTEGER AS rank FROM r QUALIFY rank <= 50""")
def quality_rankings(spark: SparkSession, d: str) -> DataFrame:
    """The top 50 by missing frames, by missing context, and of runs."""
    c = canonical(spark, d)
    v = c.groupBy("video_id").agg(F.count_if(~F.col("yunet_success")).alias("missing"), F.count_if(F.col("context_selected") & ~F.col("context_crop_available")).alias("context"))
    name = lambda x, n, start: x.select(F.lit(n).alias("ranking"), "video_id", start.alias("start"), "rank")
    a = name(top_k(v, [F.desc("missing"), F.desc("context"), F.col("video_id")], 50), "missing", F.lit(0))
    b = name(top_k(v, [F.desc("context"), F.desc("missing"), F.col("video_id")], 50), "context", F.lit(0))
    r = name(top_k(O.run_table(c), [F.desc("length"), F.col("video_id"), F.col("start")], 50), "runs", F.col("start"))
    return a.unionByName(b).unionByName(r)


@query(f"""WITH {FRAMES}, s AS (SELECT *, CASE WHEN slot % 9 = 0 THEN 'TOO_DARK' END AS reason, video_id % 11 = 0 AND slot < 9 AS failed, source_index_in_range AS r, source_index_in_range AND decode_ok AS run FROM c)
SELECT video_id, canonical_index, CASE WHEN NOT r THEN 'SOURCE_INDEX_OUT_OF_RANGE' WHEN decode_ok THEN 'OK' ELSE 'NOT_RUN' END AS decode_status,
  CASE WHEN run AND yunet_success THEN 'OK' WHEN run THEN coalesce(reason, 'YUNET_FACE_NOT_FOUND') ELSE 'NOT_RUN' END AS detector_status,
  CASE WHEN run AND yunet_success AND landmark_success THEN 'OK' WHEN run AND yunet_success THEN 'DLIB_LANDMARK_FAILED' ELSE 'NOT_RUN' END AS landmark_status,
  CASE WHEN run AND yunet_success AND landmark_success AND pose_success THEN 'OK' WHEN run AND yunet_success AND landmark_success THEN 'POSE_FAILED' ELSE 'NOT_RUN' END AS pose_status,
  CASE WHEN NOT context_selected THEN 'NOT_SELECTED' WHEN run AND yunet_success AND failed THEN 'CONTEXT_CROP_FAILED' WHEN run AND yunet_success THEN 'OK' WHEN run THEN 'CONTEXT_NO_FACE' ELSE 'NOT_AVAILABLE' END AS context_status,
  array_to_string(list_filter([CASE WHEN NOT r THEN 'SOURCE_INDEX_OUT_OF_RANGE' END, CASE WHEN run AND NOT yunet_success THEN coalesce(reason, 'YUNET_FACE_NOT_FOUND') END, CASE WHEN run AND yunet_success AND NOT landmark_success THEN 'DLIB_LANDMARK_FAILED' END,
    CASE WHEN run AND yunet_success AND landmark_success AND ear IS NULL THEN 'EAR_INVALID' END, CASE WHEN run AND yunet_success AND landmark_success AND mar IS NULL THEN 'MAR_INVALID' END,
    CASE WHEN run AND yunet_success AND landmark_success AND NOT pose_success THEN 'POSE_FAILED' END, CASE WHEN run AND yunet_success AND context_selected AND failed THEN 'CONTEXT_CROP_FAILED' END], lambda x: x IS NOT NULL), ';') AS failure_flags FROM s""")
def status_chain(spark: SparkSession, d: str) -> DataFrame:
    """How far each frame came, and why no further."""
    c = canonical(spark, d).withColumns({"in_range": F.col("source_index_in_range"), "detector_reason": F.expr("CASE WHEN slot % 9 = 0 THEN 'TOO_DARK' END"), "crop_failed": F.expr("video_id % 11 = 0 AND slot < 9")})
    return O.status_chain(c).select("video_id", "canonical_index", "decode_status", "detector_status", "landmark_status", "pose_status", "context_status", "failure_flags")


@query(f"""WITH {FRAMES}, o AS (SELECT * FROM c WHERE slot < 40 AND available) SELECT u.video_id, s.slot AS canonical_index, s.slot / 10.0::DOUBLE AS target_timestamp_sec, coalesce(o.decode_ok, false) AS decode_ok, coalesce(o.yunet_success, false) AS yunet_success, coalesce(o.landmark_success, false) AS landmark_success, false AS pose_success, 'NOT_RUN' AS pose_status, coalesce(round(o.ear, 6), 'nan'::DOUBLE) AS ear
FROM users u CROSS JOIN (SELECT unnest(range(0, 40))::INTEGER AS slot) s LEFT JOIN o ON o.video_id = u.video_id AND o.slot = s.slot""")
def default_frames(spark: SparkSession, d: str) -> DataFrame:
    """A row for every slot, with defaults where nothing was observed."""
    o = canonical(spark, d).where("slot < 40 AND available").select("video_id", "canonical_index", "decode_ok", "yunet_success", "landmark_success", "ear")
    e = O.with_defaults(T.users(spark, d).select("video_id"), o, 40, 10.0)
    return e.select("video_id", "canonical_index", "target_timestamp_sec", "decode_ok", "yunet_success", "landmark_success", "pose_success", "pose_status", F.round("ear", 6).alias("ear"))


@query(f"""WITH {T.USERS}, t AS (SELECT video_id, unnest(range(0, 100)) AS slot FROM users), s AS (SELECT video_id, slot AS canonical_index, CAST(floor(slot / 10.0::DOUBLE * (video_id % 25 + 5) + 0.5) AS BIGINT) AS source_frame_index, 10 * (video_id % 25 + 5) - 8 AS frame_count FROM t)
SELECT video_id, canonical_index, source_frame_index, frame_count, row_number() OVER (PARTITION BY video_id, source_frame_index ORDER BY canonical_index) > 1 AS source_index_duplicate, source_frame_index < frame_count AS source_index_in_range FROM s""")
def sampling_plan(spark: SparkSession, d: str) -> DataFrame:
    """Targets past the end stay out of range; slow sources serve several slots."""
    from seqloom.operators.resample import source_index

    u = T.users(spark, d).select("video_id", (F.col("video_id") % 25 + 5).alias("fps"))
    t = u.withColumn("canonical_index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(99).cast("long"))))
    t = t.select("video_id", "canonical_index", source_index(F.col("canonical_index") / F.lit(10.0), F.col("fps")).alias("source_frame_index"))
    return O.sampling_plan(t, u.select("video_id", (F.col("fps") * 10 - 8).alias("frame_count")))


_CHAIN = """n AS (SELECT p.*, (SELECT arg_min(q.slot, abs(q.slot - p.slot) * 1000 + q.slot) FROM p0 q WHERE q.video_id = p.video_id AND q.ok) AS near FROM p0 p)"""


def context_plan(spark: SparkSession, d: str) -> DataFrame:
    """Imputation plans of the 32 context slots, some spoilt."""
    c = canonical(spark, d).where("context_selected").select("video_id", F.col("context_slot").alias("target_context_index"), F.col("slot").alias("target_canonical_index"), "target_timestamp_sec", F.col("context_crop_available").alias("original_available"))
    c = c.withColumn("source_image_relpath", F.format_string("v/%d/%02d.jpg", "video_id", "target_context_index"))
    s = substitute(c, ["video_id"], "target_context_index", F.col("original_available"), ["source_image_relpath"]).where("source_slot IS NOT NULL")
    at = c.select("video_id", F.col("target_context_index").alias("source_slot"), F.col("target_canonical_index").alias("source_canonical_index"), F.col("target_timestamp_sec").alias("source_timestamp_sec"))
    s = s.join(at, ["video_id", "source_slot"]).withColumnRenamed("source_slot", "source_context_index")
    step = F.col("source_context_index") - F.col("target_context_index")
    s = s.withColumns({"imputation_offset_context_slots": step, "imputation_distance_context_slots": F.abs(step), "imputation_offset_canonical_slots": F.col("source_canonical_index") - F.col("target_canonical_index")})
    bad = lambda m, slot: F.expr(f"video_id % {m} = 0 AND target_context_index = {slot}")
    s = s.where(~bad(13, 31)).withColumns({
        "imputed": F.when(bad(11, 4), F.col("original_available")).otherwise(~F.col("original_available")),
        "source_timestamp_sec": F.when(bad(7, 3), F.lit(-1.0)).otherwise(F.col("source_timestamp_sec")),
        "source_image_relpath": F.when(bad(17, 2), "../x").otherwise(F.col("source_image_relpath")),
        "imputation_distance_context_slots": F.when(bad(5, 6), 99).otherwise(F.col("imputation_distance_context_slots")),
        "source_context_index": F.when(bad(3, 8), 0).otherwise(F.col("source_context_index")),
    })
    return s


@query(f"""WITH {FRAMES}, p0 AS (SELECT video_id, context_slot AS slot, slot AS k, target_timestamp_sec AS t, context_crop_available AS ok, format('v/{{}}/{{:02d}}.jpg', video_id, context_slot) AS path FROM c WHERE context_selected), {_CHAIN},
m AS (SELECT n.video_id, n.slot, n.k, n.t, n.ok, n.near, CASE WHEN n.video_id % 3 = 0 AND n.slot = 8 THEN 0 ELSE n.near END AS src, q.k AS sk, CASE WHEN n.video_id % 7 = 0 AND n.slot = 3 THEN -1 ELSE q.t END AS st, CASE WHEN n.video_id % 17 = 0 AND n.slot = 2 THEN '../x' ELSE q.path END AS spath,
  n.near - n.slot AS off, CASE WHEN n.video_id % 5 = 0 AND n.slot = 6 THEN 99 ELSE abs(n.near - n.slot) END AS dist, CASE WHEN n.video_id % 11 = 0 AND n.slot = 4 THEN n.ok ELSE NOT n.ok END AS imputed,
  CASE WHEN n.slot = 2 AND n.video_id % 17 = 0 THEN '../x' ELSE q.path END AS own FROM n JOIN p0 q ON q.video_id = n.video_id AND q.slot = n.near WHERE NOT (n.video_id % 13 = 0 AND n.slot = 31)),
j AS (SELECT m.*, z.ok AS z_ok, z.k AS z_k, z.t AS z_t, z.spath AS z_path, (SELECT arg_min(y.slot, abs(y.slot - m.slot) * 1000 + y.slot) FROM m y WHERE y.video_id = m.video_id AND y.ok) AS near2 FROM m LEFT JOIN m z ON z.video_id = m.video_id AND z.slot = m.src),
e AS (SELECT video_id, slot, 'MASKS' AS error FROM j WHERE ok = imputed UNION ALL SELECT video_id, slot, 'CHAINED_SOURCE' FROM j WHERE NOT coalesce(z_ok, false) UNION ALL SELECT video_id, slot, 'NEAREST_SOURCE' FROM j WHERE src IS DISTINCT FROM near2
UNION ALL SELECT video_id, slot, 'SOURCE_PROVENANCE' FROM j WHERE sk <> z_k OR st <> z_t OR spath <> z_path UNION ALL SELECT video_id, slot, 'OFFSETS' FROM j WHERE off <> src - slot OR dist <> abs(src - slot) OR sk - k <> sk - k
UNION ALL SELECT video_id, slot, 'UNSAFE_PATH' FROM j WHERE spath = '../x' UNION ALL SELECT video_id, NULL, 'SLOTS' FROM m GROUP BY video_id HAVING count(*) <> 32) SELECT video_id, slot AS target_context_index, error FROM e""")
def context_plan_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every plan against an independent recomputation: no substitute of a substitute."""
    return O.context_plan_errors(context_plan(spark, d)).select("video_id", "target_context_index", "error")


_F6 = "[ear, mar, pitch_raw, pitch_centered_candidate, yaw, roll]"
_PACKED = f"""k AS (SELECT video_id, split, label, list({_F6} ORDER BY slot) AS f, list(yunet_success ORDER BY slot) AS det, list(landmark_success ORDER BY slot) AS lm, list(pose_success AND {_POSES} ORDER BY slot) AS pose, list(yunet_success AND landmark_success AND {_fin('ear')} AND {_fin('mar')} ORDER BY slot) AS beh FROM c GROUP BY ALL)"""


@query(f"""WITH {FRAMES}, {_PACKED}, {T.runs_sql('NOT yunet_success', 'mr', 'c')}, l AS (SELECT video_id, max(length) AS run FROM mr GROUP BY video_id)
SELECT k.video_id, split, label, list_transform(flatten(f), lambda x: CASE WHEN x IS NULL OR NOT isfinite(x) THEN -1 ELSE round(x::FLOAT::DOUBLE, 3) END) AS features, list_transform(flatten(f), lambda x: x IS NOT NULL AND isfinite(x)) AS feature_valid,
  det AS detector_valid, lm AS landmark_valid, pose AS pose_valid, beh AS behavior_valid, coalesce(run, 0)::INTEGER AS longest_missing_run FROM k LEFT JOIN l ON l.video_id = k.video_id""")
def behavior_plan(spark: SparkSession, d: str) -> DataFrame:
    """Frames as they are, as arrays of 32-bit values with their masks."""
    rounded = F.transform(F.flatten("features"), lambda x: F.when(F.isnan(x), F.lit(-1.0)).otherwise(F.round(x.cast("double"), 3)))
    return O.behavior_plan(canonical(spark, d)).withColumns({"features": rounded, "feature_valid": F.flatten("feature_valid")})


def spoilt(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = canonical(spark, d)
    p = O.behavior_plan(c)
    flip = lambda m: F.transform(m, lambda x, i: F.when(i == 1, ~x).otherwise(x))
    put = lambda v: F.transform("features", lambda f, i: F.when(i == 2, F.transform(f, lambda x, j: F.when(j == 0, F.lit(v).cast("float")).otherwise(x))).otherwise(f))
    p = p.withColumns({
        "features": F.when(F.expr("video_id % 5 = 0"), put(float("inf"))).when(F.expr("video_id % 7 = 0"), put(123.5)).otherwise(F.col("features")),
        "behavior_valid": F.when(F.expr("video_id % 3 = 0"), flip("behavior_valid")).otherwise(F.col("behavior_valid")),
        "longest_missing_run": F.when(F.expr("video_id % 11 = 0"), -1).otherwise(F.col("longest_missing_run")),
    })
    return p, c


_SPOILT = f"""s AS (SELECT video_id, slot, ear, mar, CASE WHEN slot = 2 AND video_id % 5 = 0 THEN 'inf'::DOUBLE WHEN slot = 2 AND video_id % 7 = 0 THEN 123.5::DOUBLE ELSE ear END AS e2, {_fin('ear')} AS v1, {_fin('mar')} AS v2,
  yunet_success AND landmark_success AS marked, CASE WHEN slot = 1 AND video_id % 3 = 0 THEN NOT (yunet_success AND landmark_success AND {_fin('ear')} AND {_fin('mar')}) ELSE yunet_success AND landmark_success AND {_fin('ear')} AND {_fin('mar')} END AS beh FROM c),
g AS (SELECT *, e2 IS NOT NULL AND isfinite(e2) AS g1 FROM s),
q AS (SELECT video_id, count(*) FILTER (NOT beh AND g1 AND v2) AS false_mask_with_required_finite, count(*) FILTER (beh AND NOT (g1 AND v2)) AS required_valid_nan, count(*) FILTER (g1 <> v1) AS feature_valid_mask_mismatch, count(*) FILTER (coalesce(isinf(e2), false)) AS infinity,
  count(*) FILTER (beh <> (marked AND v1 AND v2)) AS mask, count(*) FILTER (CASE WHEN {_fin('ear')} THEN ear END IS DISTINCT FROM CASE WHEN slot = 2 AND (video_id % 5 = 0 OR video_id % 7 = 0) THEN e2 WHEN {_fin('ear')} THEN ear END) AS changed FROM g GROUP BY video_id)"""


@query(f"WITH {FRAMES}, {_SPOILT} SELECT video_id, false_mask_with_required_finite, required_valid_nan, feature_valid_mask_mismatch, infinity FROM q")
def behavior_anomalies(spark: SparkSession, d: str) -> DataFrame:
    return O.behavior_anomalies(spoilt(spark, d)[0])


@query(f"""WITH {FRAMES}, {_SPOILT}, e AS (SELECT video_id, 'INFINITY' AS error FROM q WHERE infinity > 0 UNION ALL SELECT video_id, 'FEATURE_MASK' FROM q WHERE feature_valid_mask_mismatch > 0 UNION ALL SELECT video_id, 'BEHAVIOR_MASK' FROM q WHERE mask > 0
UNION ALL SELECT video_id, 'REQUIRED_NAN' FROM q WHERE required_valid_nan > 0 UNION ALL SELECT video_id, 'MISSING_RUN' FROM q WHERE video_id % 11 = 0 UNION ALL SELECT video_id, 'CANONICAL_VALUES' FROM q WHERE changed > 0) SELECT video_id, error FROM e""")
def behavior_plan_errors(spark: SparkSession, d: str) -> DataFrame:
    """Spoilt plans against the frames they came from."""
    return O.behavior_plan_errors(*spoilt(spark, d))


_REASON = "CASE video_id % 5 WHEN 0 THEN 'longest_consecutive_run' WHEN 1 THEN 'x;highest_missing_count' WHEN 2 THEN 'highest_context_missing' WHEN 3 THEN 'isolated_single_miss' ELSE 'zero_missing_reference' END"


@query(f"""WITH {FRAMES}, {T.runs_sql('NOT yunet_success', 'mr', 'c')}, l AS (SELECT video_id, arg_min(start, -length * 1000 + start) AS a, arg_min("end", -length * 1000 + start) AS b, min(start) FILTER (length = 1) AS one FROM mr GROUP BY video_id),
k AS (SELECT video_id, list(slot ORDER BY slot) FILTER (yunet_success) AS valid, coalesce(list(slot ORDER BY slot) FILTER (context_selected AND NOT context_crop_available), []) AS lost, coalesce(list(slot ORDER BY slot) FILTER (context_selected AND context_crop_available), []) AS good, count(*) FILTER (NOT yunet_success) AS missing FROM c GROUP BY video_id),
r AS (SELECT k.*, a, b, one, {_REASON.replace("video_id", "k.video_id")} AS reason, [lost[1], lost[len(lost) // 2 + 1], lost[len(lost)]] AS picked FROM k LEFT JOIN l ON l.video_id = k.video_id),
x AS (SELECT video_id, CASE WHEN missing = 100 THEN [0, 25, 50, 75, 99] WHEN video_id % 5 IN (0, 1) AND a IS NOT NULL THEN [list_max(list_filter(valid, lambda i: i < a)), a, (a + b) // 2, b, list_min(list_filter(valid, lambda i: i > b))]
  WHEN video_id % 5 = 2 AND len(lost) > 0 THEN list_append(picked, list_min(list_transform(good, lambda g: list_min(list_transform(picked, lambda m: abs(g - m))) * 1000 + g)) % 1000)
  WHEN video_id % 5 = 3 AND one IS NOT NULL THEN list_filter([one - 1, one, one + 1], lambda i: i BETWEEN 0 AND 99) WHEN video_id % 5 = 4 AND missing = 0 THEN [0, 50, 99] END AS s FROM r)
SELECT video_id, list_sort(list_distinct(list_filter(s, lambda i: i IS NOT NULL)))[1:5]::INTEGER[] AS slots FROM x""")
def representative_slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots to look at, by why a video was chosen."""
    c = canonical(spark, d)
    return O.representative_slots(c, T.users(spark, d).select("video_id", F.expr(_REASON).alias("reason")))
