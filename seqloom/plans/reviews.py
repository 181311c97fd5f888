"""Review samples: selections, checks of sheets, counts and rates, scores and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import geometry as G
from seqloom.functions import scalars as S
from seqloom.operators import review as O
from seqloom.operators.distribution import share
from seqloom.operators.sampling import top_k
from seqloom.sources.readers import table

from . import canonical as C
from . import twins as T
from ._register import query

_V = """v AS (SELECT video_id, split, label, count(*) FILTER (NOT yunet_success) AS miss, count(*) FILTER (context_selected AND NOT context_crop_available) AS ctx FROM c GROUP BY ALL),
vr AS (SELECT video_id, max(length) AS run FROM (SELECT video_id, count(*) AS length FROM (SELECT video_id, slot - row_number() OVER (PARTITION BY video_id ORDER BY slot) AS island FROM c WHERE NOT yunet_success) GROUP BY video_id, island) GROUP BY video_id),
w AS (SELECT v.*, coalesce(run, 0) AS run FROM v LEFT JOIN vr ON vr.video_id = v.video_id)"""


def _videos(spark: SparkSession, d: str) -> DataFrame:
    from seqloom.operators.frames import run_table

    c = C.canonical(spark, d)
    v = c.groupBy("video_id", "split", "label").agg(F.count_if(~F.col("yunet_success")).alias("yunet_missing_count"), F.count_if(F.col("context_selected") & ~F.col("context_crop_available")).alias("context_missing_count"))
    r = run_table(c).groupBy("video_id").agg(F.max("length").alias("run"))
    return v.join(r, "video_id", "left").withColumn("longest_yunet_missing_run", F.coalesce("run", F.lit(0))).drop("run")


def _candidates_sql() -> str:
    steps = [("highest_missing_count", 8, "miss > 0", "miss DESC, run DESC, video_id"), ("longest_consecutive_run", 8, "run > 0", "run DESC, miss DESC, video_id"), ("highest_context_missing", 8, "ctx > 0", "ctx DESC, miss DESC, video_id"), ("isolated_single_miss", 6, "miss > 0 AND run = 1", "miss DESC, video_id"), ("zero_missing_reference", 6, "miss = 0 AND ctx = 0", "video_id")]
    parts, used = [], "SELECT NULL::BIGINT AS video_id WHERE false"
    for i, (name, quota, test, order) in enumerate(steps):
        parts.append(f"s{i} AS (SELECT video_id, '{name}' AS reason FROM (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY {order}) AS turn FROM w WHERE {test} AND video_id NOT IN ({used})) ORDER BY turn, split, label LIMIT least({quota}, 36 - (SELECT count(*) FROM ({used}))))")
        used = " UNION ALL ".join(f"SELECT video_id FROM s{j}" for j in range(i + 1))
    parts.append(f"have AS (SELECT split, label, count(*) AS have FROM w WHERE video_id IN ({used}) GROUP BY ALL), f AS (SELECT w.video_id, 'balanced_fill' AS reason FROM w LEFT JOIN have ON have.split = w.split AND have.label = w.label WHERE w.video_id NOT IN ({used}) ORDER BY coalesce(have, 0), miss DESC, w.video_id LIMIT greatest(0, 36 - (SELECT count(*) FROM ({used}))))")
    return f"WITH {C.FRAMES}, {_V}, {', '.join(parts)} " + " UNION ALL ".join(f"SELECT video_id, reason FROM {x}" for x in ["s0", "s1", "s2", "s3", "s4", "f"])


@query(_candidates_sql())
def choose_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Five reasons in turn, dealt from strata, none twice, then a fill."""
    return O.choose_candidates(_videos(spark, d)).select("video_id", "reason")


_SAMPLE = {
    "sample_id": "l_orderkey * 10 + l_linenumber", "video_id": "l_suppkey", "split": "CASE WHEN l_orderkey % 5 = 0 THEN 'val' ELSE 'train' END", "label": "CASE WHEN l_partkey % 2 = 0 THEN 'pos' ELSE 'neg' END",
    "normalized_landmark_diff": "(l_partkey * 7 + l_linenumber) % 101 / 100.0D", "ear_abs_diff": "(l_suppkey * 13 + l_orderkey) % 89 / 100.0D", "mar_abs_diff": "(l_partkey * 3 + l_orderkey) % 97 / 100.0D",
    "pitch_circular_diff": "(l_orderkey * 5 + l_linenumber) % 83 / 10.0D", "yaw_circular_diff": "CASE WHEN l_linenumber = 7 THEN NULL ELSE (l_orderkey * 11 + l_suppkey) % 79 / 10.0D END", "roll_circular_diff": "(l_partkey * 17) % 73 / 10.0D",
    "crop_mean_abs_diff": "(l_partkey + l_orderkey) % 71 / 100.0D", "hog_crop_padding_fraction": "CASE WHEN l_linenumber = 3 THEN (l_orderkey % 50) / 100.0D ELSE 0.0D END", "yunet_crop_padding_fraction": "CASE WHEN l_linenumber = 4 THEN (l_orderkey % 40) / 100.0D ELSE 0.0D END",
    "why": "CASE WHEN l_orderkey < 8 AND l_linenumber < 3 THEN 'BOTH_FAIL' WHEN l_orderkey < 5 THEN 'HOG_ONLY' ELSE 'BOTH_SUCCESS' END",
}
_SAMPLES = f"samples AS (SELECT {', '.join(f'{C._duck(e)} AS {c}' for c, e in _SAMPLE.items())} FROM lineitem)"


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(*[F.expr(e).alias(c) for c, e in _SAMPLE.items()])


_TOPS = "tops AS (" + " UNION ALL ".join(f"SELECT sample_id, video_id, {i} AS m, '{flag}' AS flag, row_number() OVER (ORDER BY {m} DESC, sample_id) AS p FROM samples WHERE {m} IS NOT NULL QUALIFY p <= 8" for i, (m, flag) in enumerate(O.METRICS)) + ")"
_SIX = [m for m, _ in O.METRICS[:6]]
_NORMAL = f"mid AS (SELECT {', '.join(f'quantile_cont({m}, 0.5) AS m{i}' for i, m in enumerate(_SIX))} FROM samples), norm AS (SELECT * FROM samples, mid WHERE why = 'BOTH_SUCCESS' AND hog_crop_padding_fraction <= 0 AND yunet_crop_padding_fraction <= 0 AND {' AND '.join(f'{m} <= m{i}' for i, m in enumerate(_SIX))})"


@query(f"""WITH {_SAMPLES}, {_TOPS}, {_NORMAL}, bad AS (SELECT sample_id, why FROM samples WHERE why <> 'BOTH_SUCCESS'),
fl AS (SELECT sample_id, list(DISTINCT flag) AS flags, arg_min(flag, p * 100 + m) AS first_flag, min(p * 100 + m) AS o FROM tops GROUP BY sample_id),
ext AS (SELECT *, row_number() OVER (ORDER BY o) AS rn FROM fl WHERE sample_id NOT IN (SELECT sample_id FROM bad) QUALIFY rn <= 35 - (SELECT count(*) FROM bad)),
ref AS (SELECT sample_id, row_number() OVER (ORDER BY turn, split, label) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY sample_id) AS turn FROM norm) WHERE sample_id NOT IN (SELECT sample_id FROM ext) QUALIFY rn <= least(10, 45 - (SELECT count(*) FROM bad) - (SELECT count(*) FROM ext)))
SELECT b.sample_id, 'detector_failures' AS review_group, array_to_string(list_sort(list_concat([why], coalesce(flags, []))), ';') AS reasons FROM bad b LEFT JOIN fl ON fl.sample_id = b.sample_id
UNION ALL SELECT sample_id, CASE WHEN first_flag IN ('LARGE_LANDMARK_DIFF', 'LARGE_EAR_DIFF', 'LARGE_MAR_DIFF') THEN 'landmark_ear_mar' ELSE 'pose_crop' END, array_to_string(list_sort(flags), ';') FROM ext UNION ALL SELECT sample_id, 'normal_reference', 'NORMAL_REFERENCE' FROM ref""")
def review_samples(spark: SparkSession, d: str) -> DataFrame:
    """Failures, extremes of nine metrics in turn, and normal references."""
    return O.select_review_samples(_samples(spark, d), F.col("why"))


_has = lambda *f: f"count(*) FILTER (list_has_any(coalesce(flags, []), {list(f)}))"


@query(f"""WITH {_SAMPLES}, {_TOPS}, fl AS (SELECT sample_id, list(DISTINCT flag) AS flags FROM tops GROUP BY sample_id), g AS (SELECT video_id, count(*) AS sample_count, {_has('LARGE_LANDMARK_DIFF')} AS landmark_outlier_count, {_has('LARGE_EAR_DIFF')} AS ear_outlier_count, {_has('LARGE_MAR_DIFF')} AS mar_outlier_count,
  {_has('LARGE_PITCH_DIFF', 'LARGE_YAW_DIFF', 'LARGE_ROLL_DIFF')} AS pose_outlier_count, {_has('LARGE_CROP_DIFF', 'HOG_CROP_PADDING', 'YUNET_CROP_PADDING')} AS crop_outlier_count, coalesce(sum(len(flags)), 0)::BIGINT AS total_outlier_flags FROM samples s LEFT JOIN fl ON fl.sample_id = s.sample_id GROUP BY video_id)
SELECT * FROM g WHERE total_outlier_flags > 0""")
def repeated_outliers(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d)
    return O.repeated_flags(s, O.extremes(s))


@query("""WITH p AS (SELECT s_suppkey, s_nationkey FROM supplier WHERE s_nationkey < 3), u AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 <> 0),
a AS (SELECT s_suppkey, 0 AS g, s_nationkey AS o FROM p WHERE s_suppkey IN (SELECT s_suppkey FROM u)), b AS (SELECT s_suppkey, 1 AS g, 0 AS o FROM u WHERE s_suppkey NOT IN (SELECT s_suppkey FROM a))
SELECT s_suppkey, row_number() OVER (ORDER BY g, o, s_suppkey)::INTEGER AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY place <= 12""")
def filled_selection(spark: SparkSession, d: str) -> DataFrame:
    """A list that is used again, filled up in order."""
    s = table(spark, d, "supplier")
    return O.fill_selection(s.where("s_nationkey < 3"), s.where("s_suppkey % 3 <> 0"), "s_suppkey", "s_nationkey", 12)


@query(f"""WITH {T.USERS}, {T.frames_sql(32)}, {T.state_sql(32)}, x AS (SELECT video_id, split, label, missing FROM state), a AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY missing DESC, video_id) = 1 AS head FROM x WHERE missing > 0)
SELECT video_id, row_number() OVER (ORDER BY head DESC, CASE WHEN head THEN split || '/' || label END, missing DESC, split, label, video_id)::INTEGER AS place FROM a QUALIFY place <= 8""")
def pilot_videos(spark: SparkSession, d: str) -> DataFrame:
    """One video of each stratum, then others up to eight."""
    v = T.state(T.frames(spark, d, 32)).withColumnRenamed("missing", "imputed_slots")
    return O.pilot(v, 8, True)


@query(f"""WITH {T.USERS}, {T.frames_sql(32)}, s AS (SELECT video_id, slot, n_events * 10 + slot % 7 AS score FROM frames), b AS (SELECT u.video_id, split, label, max(score) AS best FROM users u JOIN s ON s.video_id = u.video_id GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY best DESC, video_id) AS high FROM b), l AS (SELECT *, row_number() OVER (PARTITION BY split, label, high > 2 ORDER BY best, video_id) AS low FROM h), k AS (SELECT video_id FROM l WHERE high <= 2 OR low = 1)
SELECT video_id, 'first' AS role, 0 AS slot FROM k UNION ALL SELECT video_id, 'last', 31 FROM k UNION ALL SELECT s.video_id, 'middle', slot FROM s JOIN k ON k.video_id = s.video_id WHERE slot BETWEEN 1 AND 30 QUALIFY row_number() OVER (PARTITION BY s.video_id ORDER BY score DESC, abs(slot - 15), slot) = 1""")
def review_slots(spark: SparkSession, d: str) -> DataFrame:
    """Two high and one low video a stratum, three slots of each."""
    s = T.frames(spark, d, 32).select("video_id", "slot", (F.col("n_events") * 10 + F.col("slot") % 7).alias("score"))
    return O.review_slots(T.users(spark, d), s)


_PAIR = "pair AS (SELECT o_orderkey AS video_id, o_orderpriority AS label, (o_custkey * 31 % 997) / 100.0::DOUBLE AS loss_a, (o_custkey * 31 % 997 + o_orderkey % 13) / 100.0::DOUBLE AS loss_b, o_custkey % 3 <> 0 AS correct_a, o_custkey % 7 <> 0 AS correct_b FROM orders)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.selectExpr("o_orderkey AS video_id", "o_orderpriority AS label", "(o_custkey * 31 % 997) / 100.0D AS loss_a", "(o_custkey * 31 % 997 + o_orderkey % 13) / 100.0D AS loss_b", "o_custkey % 3 <> 0 AS correct_a", "o_custkey % 7 <> 0 AS correct_b")


@query(f"""WITH {_PAIR}, a AS (SELECT video_id FROM pair ORDER BY loss_a DESC, video_id LIMIT 20), b AS (SELECT video_id FROM pair ORDER BY loss_b DESC, video_id LIMIT 20), h AS (SELECT * FROM pair WHERE video_id IN (SELECT video_id FROM a) AND video_id IN (SELECT video_id FROM b))
SELECT video_id, 'hard' AS sample_group, row_number() OVER (ORDER BY greatest(loss_a, loss_b) DESC, loss_a + loss_b DESC, video_id)::INTEGER AS place FROM h
UNION ALL SELECT video_id, 'control', row_number() OVER (PARTITION BY label ORDER BY greatest(loss_a, loss_b), (loss_a + loss_b) / 2, video_id)::INTEGER AS place FROM pair WHERE correct_a AND correct_b AND video_id NOT IN (SELECT video_id FROM h) QUALIFY place <= 6""")
def hard_and_control(spark: SparkSession, d: str) -> DataFrame:
    return O.hard_and_control(_pairs(spark, d))


@query(f"WITH {_PAIR} SELECT video_id, label, loss_a, loss_b FROM pair WHERE NOT correct_a AND NOT correct_b")
def both_incorrect(spark: SparkSession, d: str) -> DataFrame:
    """Samples that both models have wrong, each once."""
    from seqloom.operators.joins import require_unique

    return require_unique(_pairs(spark, d).where("NOT correct_a AND NOT correct_b"), ["video_id"]).select("video_id", "label", "loss_a", "loss_b")


_ROI = {
    **{f"{c}_{f}": e for i, c in enumerate(("raw", "m05", "m10", "m15")) for f, e in (("ear", f"(l_partkey * {i + 3} % 53) / 100.0D"), ("mar", f"(l_suppkey * {i + 5} % 47) / 100.0D"), ("pitch_raw", f"(l_orderkey * {i + 1} % 720) - 360.0D"), ("yaw", f"(l_partkey * {i + 2} % 360) - 180.0D"), ("roll", f"(l_suppkey * {i + 7} % 90) - 45.0D"))},
    **{f"raw_{c}_normalized_landmark_diff": f"(l_orderkey * {i + 3} % 31) / 100.0D" for i, c in enumerate(("m05", "m10", "m15"))},
    **{f"{c}_roi_clipped": f"l_quantity > {40 - 5 * i}" for i, c in enumerate(("m05", "m10", "m15"))}, **{f"{c}_clipped_fraction": f"(l_orderkey % {7 + i}) / 100.0D" for i, c in enumerate(("m05", "m10", "m15"))},
    "yunet_confidence": "0.5D + l_linenumber / 20.0D",
}
_ROIS = f"roi AS (SELECT l_orderkey, l_linenumber, {', '.join(f'{C._duck(e)} AS {c}' for c, e in _ROI.items())} FROM lineitem)"


def _rois(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr(e).alias(c) for c, e in _ROI.items()])


_M = ("m05", "m10", "m15")
_wrap = lambda x: f"abs(((({x}) + 180) % 360 + 360) % 360 - 180)"
_mostabs = lambda f: "greatest(" + ", ".join(f"abs(raw_{f} - {c}_{f})" for c in _M) + ")"
_LM = "greatest(" + ", ".join(f"raw_{c}_normalized_landmark_diff" for c in _M) + ")"


@query(f"""WITH {_ROIS} SELECT l_orderkey, l_linenumber, round({_mostabs('ear')} + {_LM}, 6) AS eye_score, round({_mostabs('mar')} + {_LM}, 6) AS mouth_score, round(greatest({', '.join(_wrap(f'raw_{f} - {c}_{f}') for c in _M for f in ('pitch_raw', 'yaw', 'roll'))}) + 20 * {_LM}, 6) AS pose_score,
  round({' + '.join(f'{c}_roi_clipped::INTEGER' for c in _M)} + 20 * greatest({', '.join(f'{c}_clipped_fraction' for c in _M)}) + abs(raw_yaw) / 45 + greatest(0, 1 - yunet_confidence), 6) AS difficult_score FROM roi""")
def review_scores(spark: SparkSession, d: str) -> DataFrame:
    return _rois(spark, d).select("l_orderkey", "l_linenumber", *[F.round(x, 6).alias(n) for n, x in O.review_scores().items()])


_GROUPS = ("eye", "mouth", "pose", "difficult")
_FOUR = ("eye_score", "mouth_score", "pose_score", "difficult_score")
_FIRST_LINE = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
_REVIEWED = f"""li AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_FIRST_LINE)}) = 1),
own AS (SELECT l_orderkey, l_returnflag, {', '.join(f'{C._duck(e)} AS {c}' for c, e in _ROI.items())} FROM li),
sc AS (SELECT l_orderkey AS sample_id, CASE WHEN l_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, l_returnflag AS label, round({_mostabs('ear')} + {_LM}, 6) AS eye_score, round({_mostabs('mar')} + {_LM}, 6) AS mouth_score,
  round(greatest({', '.join(_wrap(f'raw_{f} - {c}_{f}') for c in _M for f in ('pitch_raw', 'yaw', 'roll'))}) + 20 * {_LM}, 6) AS pose_score, round({' + '.join(f'{c}_roi_clipped::INTEGER' for c in _M)} + 20 * greatest({', '.join(f'{c}_clipped_fraction' for c in _M)}) + abs(raw_yaw) / 45 + greatest(0, 1 - yunet_confidence), 6) AS difficult_score
  FROM own QUALIFY row_number() OVER (ORDER BY l_orderkey % 83, l_orderkey) <= 35)"""
_SCALED = ", ".join(f"coalesce(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0), 0) AS n{i}" for i, c in enumerate(_FOUR, 1))
_TAKES = "r.room[p.k] > 0 AND NOT list_contains(r.taken, p.sample_id)"


@query(f"""WITH RECURSIVE {_REVIEWED}, n AS (SELECT *, {_SCALED} FROM sc),
ref AS (SELECT sample_id FROM (SELECT sample_id, split, label, row_number() OVER (PARTITION BY split, label ORDER BY n1 + n2 + n3 + n4, sample_id) AS turn FROM n) ORDER BY turn, split, label LIMIT 7),
p AS (SELECT *, row_number() OVER (ORDER BY score DESC, sample_id DESC, g DESC) AS i FROM ({' UNION ALL '.join(f"SELECT n{k} AS score, sample_id, '{g}' AS g, {k} AS k FROM n WHERE sample_id NOT IN (SELECT sample_id FROM ref)" for k, g in enumerate(_GROUPS, 1))})),
r(i, room, taken, sample_id, g) AS (SELECT 0::BIGINT, [7, 7, 7, 7], []::BIGINT[], NULL::BIGINT, NULL::VARCHAR
  UNION ALL SELECT p.i, CASE WHEN {_TAKES} THEN list_transform(r.room, lambda x, j: CASE WHEN j = p.k THEN x - 1 ELSE x END) ELSE r.room END, CASE WHEN {_TAKES} THEN list_append(r.taken, p.sample_id) ELSE r.taken END, CASE WHEN {_TAKES} THEN p.sample_id END, p.g FROM r JOIN p ON p.i = r.i + 1),
a AS (SELECT sample_id, 'overview' AS g, 0 AS sheet, 0.0::DOUBLE AS own FROM ref UNION ALL SELECT r.sample_id, g, list_position(['eye', 'mouth', 'pose', 'difficult'], g), CASE g WHEN 'eye' THEN eye_score WHEN 'mouth' THEN mouth_score WHEN 'pose' THEN pose_score ELSE difficult_score END::DOUBLE FROM r JOIN n USING (sample_id))
SELECT sample_id, g AS review_group, row_number() OVER (ORDER BY sheet, own DESC, sample_id)::INTEGER AS review_order,
  CASE g WHEN 'overview' THEN 'LOW_MULTI_METRIC_CHANGE;BALANCED_NORMAL_REFERENCE' ELSE CASE g WHEN 'eye' THEN 'EAR_CHANGE' WHEN 'mouth' THEN 'MAR_CHANGE' WHEN 'pose' THEN 'POSE_OR_LANDMARK_CHANGE' ELSE 'ROI_EDGE_OR_DIFFICULT' END || printf(';score=%.6f;STEP2C_EXISTING_SELECTION', own::DOUBLE) END AS reason FROM a""")
def review_groups(spark: SparkSession, d: str) -> DataFrame:
    """35 samples: seven calm references, the others by their highest score that has room."""
    from seqloom.operators.assignment import assign_review_groups
    from seqloom.operators.sampling import top_k

    li = top_k(table(spark, d, "lineitem"), [F.col(c) for c in _FIRST_LINE], 1, ["l_orderkey"]).drop("rank")
    own = li.select("l_orderkey", "l_returnflag", *[F.expr(e).alias(c) for c, e in _ROI.items()])
    s = own.selectExpr("*", "CASE WHEN l_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split").select(F.col("l_orderkey").alias("sample_id"), "split", F.col("l_returnflag").alias("label"), *[F.round(x, 6).alias(n) for n, x in O.review_scores().items()])
    return assign_review_groups(top_k(s, [F.col("sample_id") % 83, F.col("sample_id")], 35).drop("rank"))


_DIFF = " UNION ALL ".join(f"SELECT '{a}_{b}' AS pair, '{f}' AS feature, {_wrap(f'{a}_{f} - {b}_{f}') if f in ('pitch_raw', 'yaw', 'roll') else f'abs({a}_{f} - {b}_{f})'} AS d FROM roi" for a, b in (("raw", "m05"), ("raw", "m10"), ("raw", "m15"), ("m05", "m10"), ("m10", "m15")) for f in ("ear", "mar", "pitch_raw", "yaw", "roll"))


@query(f"WITH {_ROIS}, d AS ({_DIFF}) SELECT pair, feature, count(d) AS n, round(min(d), 6) AS min, round(avg(d), 6) AS mean, round(stddev_pop(d), 6) AS std, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, round(max(d), 6) AS max FROM d GROUP BY pair, feature")
def candidate_differences(spark: SparkSession, d: str) -> DataFrame:
    """Differences between margins, feature by feature, circular for angles."""
    pairs = (("raw", "m05"), ("raw", "m10"), ("raw", "m15"), ("m05", "m10"), ("m10", "m15"))
    x = O.pairwise_differences(_rois(spark, d), "l_orderkey", ("ear", "mar", "pitch_raw", "yaw", "roll"), ("pitch_raw", "yaw", "roll"), pairs)
    return x.select("pair", "feature", "n", *[F.round(c, 6).alias(c) for c in ("min", "mean", "std", "median", "p95", "max")])


@query(f"WITH {_ROIS} SELECT l_orderkey, l_linenumber, round({_wrap('raw_yaw - m10_yaw')}, 6) AS yaw, round(abs(raw_ear - m10_ear), 6) AS ear, CASE WHEN l_linenumber = 7 THEN NULL ELSE round(abs(raw_ear - raw_mar), 6) END AS both_there FROM roi")
def feature_differences(spark: SparkSession, d: str) -> DataFrame:
    """Circular for angles, absolute for ratios, null where one side is."""
    r = _rois(spark, d).withColumn("mar", F.when(F.col("l_linenumber") != 7, F.col("raw_mar")))
    return r.select("l_orderkey", "l_linenumber", F.round(G.circular_difference(F.col("raw_yaw"), F.col("m10_yaw")), 6).alias("yaw"), F.round(S.difference(F.col("raw_ear"), F.col("m10_ear")), 6).alias("ear"), F.round(S.difference(F.col("raw_ear"), F.col("mar")), 6).alias("both_there"))


_CHAIN = {
    "split": "CASE WHEN l_orderkey % 5 = 0 THEN 'val' ELSE 'train' END", "source_frame_index": "CASE WHEN l_quantity = 1 THEN -1 ELSE l_linenumber END", "hog_success": "l_quantity > 1 AND l_discount < 0.06D", "hog_detection_count": "CASE WHEN l_quantity > 1 THEN l_linenumber % 3 END",
    "yunet_attempted": "l_quantity > 1 AND l_discount >= 0.06D", "yunet_success": "l_quantity > 1 AND l_discount >= 0.06D AND l_tax < 0.05D", "detector_source": "CASE WHEN l_quantity > 1 AND l_discount < 0.06D THEN 'HOG' WHEN l_quantity > 1 AND l_tax < 0.05D THEN 'YUNET_FALLBACK' ELSE 'NONE' END",
    "landmark_success": "l_quantity > 1 AND (l_discount < 0.06D OR l_tax < 0.05D) AND l_linenumber < 6", "head_pose_valid": "l_quantity > 1 AND (l_discount < 0.06D OR l_tax < 0.05D) AND l_linenumber < 4",
}
_r = lambda a, b: f"coalesce(({a}) / nullif({b}, 0)::DOUBLE, 0)"
_n = lambda c: f"count(*) FILTER ({c})"


@query(f"""WITH x AS (SELECT {', '.join(f'{C._duck(e)} AS {c}' for c, e in _CHAIN.items())} FROM lineitem), g AS (SELECT split, count(*) AS frames, {_n('source_frame_index <> -1')} AS hog_attempted, {_n('hog_success')} AS hog_success, {_n('coalesce(hog_detection_count, 0) > 1')} AS multiple_detection_count, {_n('yunet_attempted')} AS yunet_attempted, {_n('yunet_success')} AS recovered,
  {_n("detector_source <> 'NONE'")} AS final_success, {_n("detector_source = 'HOG'")} AS hog_landmark_attempted, {_n("detector_source = 'HOG' AND landmark_success")} AS hog_landmark_success, {_n("detector_source = 'YUNET_FALLBACK'")} AS yunet_landmark_attempted, {_n("detector_source = 'YUNET_FALLBACK' AND landmark_success")} AS yunet_landmark_success,
  {_n('landmark_success')} AS pose_attempted, {_n('head_pose_valid')} AS pose_success FROM x GROUP BY split)
SELECT *, hog_attempted - hog_success AS hog_failure, {_r('hog_success', 'hog_attempted')} AS hog_success_rate, {_r('recovered', 'yunet_attempted')} AS recovery_rate, {_r('final_success', 'frames')} AS final_success_rate, {_r('hog_landmark_success', 'hog_landmark_attempted')} AS hog_landmark_rate, {_r('yunet_landmark_success', 'yunet_landmark_attempted')} AS yunet_landmark_rate, {_r('pose_success', 'pose_attempted')} AS pose_success_rate FROM g""")
def fallback_chain(spark: SparkSession, d: str) -> DataFrame:
    """A detector, its fallback, and what follows from either."""
    return O.fallback_chain(table(spark, d, "lineitem").select(*[F.expr(e).alias(c) for c, e in _CHAIN.items()]), ["split"])


_ENUM = ("consistent", "ambiguous", "conflicting", "cannot_judge")
_MAP = {"no_issue": "consistent", "unclear": "ambiguous", "manual_label_mismatch_candidate": "conflicting"}
_SHEET = """sheet AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE o_orderpriority END AS label, CASE WHEN o_custkey % 11 = 0 THEN 'odd' WHEN o_custkey % 3 = 0 THEN 'no_issue' WHEN o_custkey % 3 = 1 THEN 'unclear' ELSE 'manual_label_mismatch_candidate' END AS status,
  CASE WHEN o_custkey % 13 = 0 THEN 'cannot_judge' WHEN o_custkey % 3 = 0 THEN 'consistent' WHEN o_custkey % 3 = 1 THEN 'ambiguous' ELSE 'conflicting' END AS consistency, CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'seen' END AS optional FROM orders WHERE o_orderkey % 101 <> 0)"""


def _sheet(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").where("o_orderkey % 101 <> 0")
    return o.selectExpr("o_orderkey AS id", "CASE WHEN o_orderkey % 97 = 0 THEN 'x' ELSE o_orderpriority END AS label", "CASE WHEN o_custkey % 11 = 0 THEN 'odd' WHEN o_custkey % 3 = 0 THEN 'no_issue' WHEN o_custkey % 3 = 1 THEN 'unclear' ELSE 'manual_label_mismatch_candidate' END AS status", "CASE WHEN o_custkey % 13 = 0 THEN 'cannot_judge' WHEN o_custkey % 3 = 0 THEN 'consistent' WHEN o_custkey % 3 = 1 THEN 'ambiguous' ELSE 'conflicting' END AS consistency", "CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'seen' END AS optional")


@query(f"""WITH {_SHEET}, j AS (SELECT o.o_orderkey AS id, o.o_orderpriority AS own, s.* EXCLUDE (id), s.id IS NOT NULL AS there FROM orders o LEFT JOIN sheet s ON s.id = o.o_orderkey), e AS (SELECT id, 'NOT_REVIEWED' AS rule FROM j WHERE NOT there UNION ALL SELECT id, 'IDENTITY:label' FROM j WHERE there AND label <> own
UNION ALL SELECT id, 'VALUE:status' FROM j WHERE there AND status = 'odd' UNION ALL SELECT id, 'FOLLOWS:consistency' FROM j WHERE there AND status <> 'odd' AND consistency <> CASE status WHEN 'no_issue' THEN 'consistent' WHEN 'unclear' THEN 'ambiguous' ELSE 'conflicting' END) SELECT id, rule FROM e""")
def review_errors(spark: SparkSession, d: str) -> DataFrame:
    """A filled sheet against its candidates, its enumerations and what follows from what."""
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"))
    return O.review_errors(c, _sheet(spark, d), "id", ["label"], {"status": list(_MAP), "consistency": _ENUM, "optional": ["seen"]}, ("status", "consistency", _MAP), optional=["optional"])


@query(f"""WITH {_SHEET}, l AS (SELECT 'overall' AS scope, consistency FROM sheet UNION ALL SELECT label, consistency FROM sheet), s AS (SELECT DISTINCT scope FROM l), v AS (SELECT unnest({list(_ENUM)}) AS value)
SELECT s.scope, v.value, count(*) FILTER (l.consistency = v.value) AS n, count(*) FILTER (l.consistency = v.value) / count(*)::DOUBLE AS rate FROM s CROSS JOIN v JOIN l ON l.scope = s.scope GROUP BY 1, 2""")
def review_rates(spark: SparkSession, d: str) -> DataFrame:
    """Counts and rates of verdicts, overall and by label, zeros included."""
    return O.rates(_sheet(spark, d), "consistency", _ENUM, "label")


@query(f"""WITH {_SHEET}, g AS (SELECT label, count(*) AS n, avg((optional = 'seen')::INTEGER) AS seen, avg((consistency = 'conflicting')::INTEGER) AS conflict FROM sheet GROUP BY label) SELECT label, n, round(seen, 9) AS seen, round(conflict, 9) AS conflict FROM g""")
def group_review_rates(spark: SparkSession, d: str) -> DataFrame:
    g = _sheet(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"), share(F.col("optional") == "seen").alias("seen"), share(F.col("consistency") == "conflicting").alias("conflict"))
    return g.withColumns({c: F.round(c, 9) for c in ("seen", "conflict")})


@query("""WITH r AS (SELECT n_nationkey AS review_order, CASE WHEN n_nationkey = 9 THEN 'a/b' WHEN n_nationkey = 4 THEN 'EGYPT2' WHEN n_nationkey = 5 THEN 'EGYPT2' ELSE n_name END AS id, CASE WHEN n_regionkey = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN n_nationkey = 3 THEN 'x' ELSE '' END AS note FROM nation)
SELECT 'ROW_COUNT' AS rule, 1::BIGINT AS n UNION ALL SELECT 'ORDER', 1 UNION ALL SELECT 'PLAIN_ID', 1 UNION ALL SELECT 'DOMAIN:split', count(*) FILTER (split = 'test') FROM r UNION ALL SELECT 'NOT_BLANK:note', 1 UNION ALL SELECT 'REPEATED_ID', 1""")
def template_errors(spark: SparkSession, d: str) -> DataFrame:
    """A candidate list of 25 rows where 36 are expected."""
    r = table(spark, d, "nation").selectExpr("n_nationkey AS review_order", "CASE WHEN n_nationkey = 9 THEN 'a/b' WHEN n_nationkey = 4 THEN 'EGYPT2' WHEN n_nationkey = 5 THEN 'EGYPT2' ELSE n_name END AS id", "CASE WHEN n_regionkey = 0 THEN 'test' ELSE 'train' END AS split", "CASE WHEN n_nationkey = 3 THEN 'x' ELSE '' END AS note")
    return O.template_errors(r, "review_order", "id", 36, {"split": ["train", "val"]}, ["note"])


_PLAN = f"""WITH {T.USERS}, {T.frames_sql(32)}, {T.state_sql(32)}, k AS (SELECT *, missing <= 8 AS ok FROM state)"""
_TOTALS = {"input_videos": "count(*)", "eligible_videos": "count(*) FILTER (ok)", "excluded_videos": "count(*) FILTER (NOT ok)", "frame_rows": "32 * count(*) FILTER (ok)", "original_valid_rows": "coalesce(sum(valid) FILTER (ok), 0)", "imputed_rows": "coalesce(sum(missing) FILTER (ok), 0)", "videos_without_imputation": "count(*) FILTER (ok AND missing = 0)", "videos_requiring_imputation": "count(*) FILTER (ok AND missing > 0)", "train": "count(*) FILTER (ok AND split = 'train')", "val": "count(*) FILTER (ok AND split = 'val')"}


@query(_PLAN + " " + " UNION ALL ".join(f"SELECT '{n}' AS name, ({e})::DOUBLE AS actual, {'15' if n == 'input_videos' else '-1'}::DOUBLE AS expected, ({e}) = {'15' if n == 'input_videos' else '-1'} AS matches FROM k" for n, e in _TOTALS.items() if n not in ("train", "val")))
def plan_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A plan's totals against what they should be."""
    k = T.state(T.frames(spark, d, 32)).withColumn("ok", F.col("missing") <= 8)
    yes = lambda c: F.count_if(F.col("ok") & c)
    total = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0))
    a = k.agg(F.count(F.lit(1)).alias("input_videos"), yes(F.lit(True)).alias("eligible_videos"), F.count_if(~F.col("ok")).alias("excluded_videos"), (32 * yes(F.lit(True))).alias("frame_rows"), total("valid").alias("original_valid_rows"), total("missing").alias("imputed_rows"), yes(F.col("missing") == 0).alias("videos_without_imputation"), yes(F.col("missing") > 0).alias("videos_requiring_imputation"))
    long = a.unpivot([], [F.col(c).cast("double").alias(c) for c in a.columns], "name", "value")
    return O.against_expected(long, {c: 15 if c == "input_videos" else -1 for c in a.columns})


@query(f"{_PLAN} SELECT count(*) AS videos, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (label = 'pos') AS pos, count(*) FILTER (label = 'neg') AS neg, count(*) FILTER (missing = 0) AS no_imputation, count(*) FILTER (missing > 0) AS imputation_required, 32 * count(*) AS target_rows, coalesce(sum(missing), 0)::BIGINT AS imputed_target_refs FROM k WHERE ok")
def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    k = T.state(T.frames(spark, d, 32)).where("missing <= 8")
    n = lambda c: F.count_if(F.expr(c))
    return k.agg(F.count(F.lit(1)).alias("videos"), n("split = 'train'").alias("train"), n("split = 'val'").alias("val"), n("label = 'pos'").alias("pos"), n("label = 'neg'").alias("neg"), n("missing = 0").alias("no_imputation"), n("missing > 0").alias("imputation_required"), (32 * F.count(F.lit(1))).alias("target_rows"), F.coalesce(F.sum("missing"), F.lit(0)).alias("imputed_target_refs"))


@query(f"WITH {T.SCORED} SELECT 'accuracy' AS name, round(avg((prediction = label)::INTEGER), 9) AS actual, 0.5::DOUBLE AS expected, abs(avg((prediction = label)::INTEGER) - 0.5) <= 0.25 AS matches FROM losses UNION ALL SELECT 'n', count(*), 1, count(*) = 1 FROM losses UNION ALL SELECT 'unknown', NULL, 2, false")
def metric_reproduction(spark: SparkSession, d: str) -> DataFrame:
    """Metrics against published ones, within a tolerance."""
    from .evaluation import losses

    a = losses(spark, d).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count(F.lit(1)).cast("double").alias("n"))
    out = O.against_expected(a.unpivot([], ["accuracy", "n"], "name", "value"), {"accuracy": 0.5, "n": 1, "unknown": 2}, 0.25)
    return out.withColumn("actual", F.round("actual", 9))


@query("""SELECT n_nationkey, CASE WHEN n_nationkey = 0 THEN 'MOSTLY_MISSING' WHEN n_nationkey = 1 THEN 'FULL_CLIP_MISSING' WHEN n_nationkey <= 23 THEN 'LONG_RUN' ELSE 'ISOLATED' END AS severity, CASE WHEN n_regionkey = 0 THEN 'SOURCE_FRAME_UNAVAILABLE' WHEN n_regionkey = 1 THEN 'DETECTOR_MISS' WHEN n_regionkey = 2 AND n_nationkey % 2 = 0 THEN 'PIPELINE_OR_STORAGE_SUSPECT' ELSE 'UNCLASSIFIED' END AS reason,
  'train_' || n_nationkey || '_t' || n_regionkey || 'p5' AS sample_id, format('context_crops/ctx_{:02d}_k{:03d}.jpg', n_nationkey, n_nationkey * 4) AS crop, CASE WHEN length(n_name) <= 8 THEN n_name ELSE n_name[1:5] || '...' END AS fitted, CASE WHEN n_regionkey = 4 THEN 'NA' ELSE format('{:.3f}', n_nationkey / 7.0::DOUBLE) END AS shown, format('{:.4f}', n_nationkey / 7.0::DOUBLE * 100) || '%' AS percent FROM nation""")
def review_labels(spark: SparkSession, d: str) -> DataFrame:
    """Names, categories and texts of a sample."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    x = n / F.lit(7.0)
    return table(spark, d, "nation").select(
        "n_nationkey", O.severity(n).alias("severity"), O.suspected_reason(r != 0, r != 1, r == 2, n % 2 == 1).alias("reason"), S.sample_id(F.lit("train"), n, r + F.lit(0.5).cast("double")).alias("sample_id"),
        S.crop_path(n.cast("int"), (n * 4).cast("int")).alias("crop"), S.fitted(F.col("n_name"), 8).alias("fitted"), S.shown(F.when(r != 4, x)).alias("shown"), S.percent(x).alias("percent"),
    )


@query(f"""WITH {T.SCORED}, h AS (SELECT sample, label, row_number() OVER (ORDER BY round(loss, 9) DESC, sample) AS rn FROM losses QUALIFY rn <= 40) SELECT sample, CASE WHEN label = 1 THEN 'TRUE' ELSE 'FALSE' END AS verdict, 'rank ' || rn AS note FROM h""")
def filled_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Manual columns by rule; frozen ones stay."""
    from .evaluation import losses

    h = top_k(losses(spark, d), [F.round("loss", 9).desc(), F.col("sample")], 40)
    sheet = h.select("sample", "label", "rank", F.lit("").alias("verdict"), F.lit("").alias("note"))
    return O.rewritten(sheet, {"verdict": F.when(F.col("label") == 1, "TRUE").otherwise("FALSE"), "note": F.concat(F.lit("rank "), F.col("rank"))}, ["sample", "label"]).select("sample", "verdict", "note")
