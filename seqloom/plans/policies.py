"""Missing-data policies, sequence construction, imputation statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import distribution as D
from seqloom.operators import policy as P
from seqloom.operators import resample as S
from seqloom.operators import rollup as R
from seqloom.sources.readers import table

from . import twins as T
from ._register import query

_F32, _F100 = T.frames_sql(32), T.frames_sql(100)


def _values(table: tuple) -> str:
    return "(VALUES " + ", ".join(f"('{c}', {n}, {P.NO_GUARD if r is None else r})" for c, n, r in table) + ") AS c(candidate, bound, run_bound)"


_CONTEXT = f"SELECT s.*, candidate, valid > 0 AND missing <= bound AND run <= run_bound AS eligible FROM state s CROSS JOIN {_values(P.CONTEXT)}"
_BEHAVIOR = f"SELECT s.*, candidate, valid >= bound AND run <= run_bound AS eligible FROM state s CROSS JOIN {_values(P.BEHAVIOR)}"
_GROUP = "CASE WHEN grouping(split) = 0 AND grouping(label) = 0 THEN 'split*label' WHEN grouping(split) = 0 THEN 'split' WHEN grouping(label) = 0 THEN 'label' ELSE 'overall' END"


def context_rows(spark: SparkSession, d: str) -> DataFrame:
    s = T.state(T.frames(spark, d, 32))
    return P.per_candidate(s, P.CONTEXT, lambda n, r: P.context_eligible(F.col("valid"), F.col("missing"), F.col("run"), n, r))


def behavior_rows(spark: SparkSession, d: str) -> DataFrame:
    s = T.state(T.frames(spark, d, 100))
    return P.per_candidate(s, P.BEHAVIOR, lambda n, r: P.behavior_eligible(F.col("valid"), F.col("run"), n, r))


@query(f"""WITH {T.USERS}, {_F32}, {T.state_sql(32)}, e AS ({_CONTEXT})
SELECT candidate, split, label, {_GROUP} AS group_type, count(*) AS total, count(*) FILTER (eligible) AS kept, round(count(*) FILTER (eligible) / count(*)::DOUBLE, 9) AS rate
FROM e GROUP BY GROUPING SETS ((candidate), (candidate, split), (candidate, label), (candidate, split, label))""")
def policy_retention_cube(spark: SparkSession, d: str) -> DataFrame:
    """How many units each context policy keeps, overall and in every stratum."""
    return P.retention(context_rows(spark, d), ["split", "label"]).withColumn("rate", F.round("rate", 9))


@query(f"""WITH {T.USERS}, {_F100}, {T.state_sql(100)}, e AS ({_BEHAVIOR})
SELECT candidate, split, label, {_GROUP} AS group_type, count(*) AS total, count(*) FILTER (eligible) AS kept, round(count(*) FILTER (eligible) / count(*)::DOUBLE, 9) AS rate
FROM e GROUP BY GROUPING SETS ((candidate), (candidate, split), (candidate, label), (candidate, split, label))""")
def behavior_retention_cube(spark: SparkSession, d: str) -> DataFrame:
    return P.retention(behavior_rows(spark, d), ["split", "label"]).withColumn("rate", F.round("rate", 9))


@query(f"""WITH {T.USERS}, {_F32}, {T.state_sql(32)}, e AS ({_CONTEXT}),
p AS (SELECT candidate, label, count(*) AS total, count(*) FILTER (eligible) AS kept FROM e GROUP BY 1, 2),
w AS (SELECT *, sum(total) OVER (PARTITION BY candidate) AS all_total, sum(kept) OVER (PARTITION BY candidate) AS all_kept FROM p)
SELECT candidate, round(max(all_kept / all_total::DOUBLE), 9) AS rate, round(min(kept / total::DOUBLE), 9) AS min_stratum_rate, round(max(CASE WHEN all_kept > 0 THEN abs(100 * (kept / all_kept::DOUBLE - total / all_total::DOUBLE)) ELSE 0 END), 6) AS max_shift FROM w GROUP BY candidate""")
def policy_impact(spark: SparkSession, d: str) -> DataFrame:
    i = P.impact(context_rows(spark, d), "label")
    return i.select("candidate", F.round("rate", 9).alias("rate"), F.round("min_stratum_rate", 9).alias("min_stratum_rate"), F.round("max_shift", 6).alias("max_shift"))


@query(f"""WITH {T.USERS}, {_F32}, {T.frames_sql(100, 'f100')}, {T.state_sql(32)}, {T.state_sql(100, 'f100', 'st100')},
c AS ({_CONTEXT}), b AS ({_BEHAVIOR.replace('FROM state s', 'FROM st100 s')}),
j AS (SELECT c.candidate AS context, b.candidate AS behavior, c.eligible AS ce, b.eligible AS be FROM c JOIN b ON b.video_id = c.video_id)
SELECT x.candidate AS context, y.candidate AS behavior, p.ce AS context_eligible, q.be AS behavior_eligible, count(j.context) AS n
FROM (SELECT DISTINCT candidate FROM c) x CROSS JOIN (SELECT DISTINCT candidate FROM b) y CROSS JOIN (SELECT unnest([true, false]) AS ce) p CROSS JOIN (SELECT unnest([true, false]) AS be) q
LEFT JOIN j ON j.context = x.candidate AND j.behavior = y.candidate AND j.ce = p.ce AND j.be = q.be GROUP BY ALL""")
def policy_cross_table(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of policies as a 2 x 2 table, zeros included."""
    c = context_rows(spark, d).select("video_id", F.col("candidate").alias("context"), F.col("eligible").alias("context_eligible"))
    b = behavior_rows(spark, d).select("video_id", F.col("candidate").alias("behavior"), F.col("eligible").alias("behavior_eligible"))
    keys = ["context", "behavior", "context_eligible", "behavior_eligible"]
    counts = c.join(b, "video_id").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    spine = spark.createDataFrame([(x[0], y[0], p, q) for x in P.CONTEXT for y in P.BEHAVIOR for p in (True, False) for q in (True, False)], "context string, behavior string, context_eligible boolean, behavior_eligible boolean")
    return R.zero_filled(counts, spine, keys, ["n"])


_REASON = "CASE WHEN valid = 0 THEN 'NO_VALID' WHEN missing > 8 AND run > 4 THEN 'COUNT_AND_RUN' WHEN missing > 8 THEN 'COUNT' WHEN run > 4 THEN 'RUN' ELSE 'NONE' END"


@query(f"""WITH {T.USERS}, {_F32}, {T.state_sql(32)} SELECT video_id, split, label, missing, run, {_REASON} AS reason, {_REASON} = 'NONE' AS eligible FROM state""")
def eligibility_manifest(spark: SparkSession, d: str) -> DataFrame:
    s = T.state(T.frames(spark, d, 32))
    reason = P.exclusion_reason(F.col("valid"), F.col("missing") > 8, F.col("run") > 4)
    return s.select("video_id", "split", "label", "missing", "run", reason.alias("reason"), (reason == "NONE").alias("eligible"))


@query(f"""WITH {T.USERS}, {_F32}, {T.state_sql(32)}, e AS ({_CONTEXT} WHERE candidate = 'C2')
SELECT video_id, eligible, array_to_string(list_filter([CASE WHEN missing = 4 THEN 'AT_COUNT' END, CASE WHEN missing = 5 THEN 'JUST_OVER_COUNT' END, CASE WHEN run = 2 THEN 'AT_RUN' END, CASE WHEN run = 3 THEN 'JUST_OVER_RUN' END], lambda x: x IS NOT NULL), ';') AS reason
FROM e WHERE missing IN (4, 5) OR run IN (2, 3)""")
def policy_edge_cases(spark: SparkSession, d: str) -> DataFrame:
    e = context_rows(spark, d).where("candidate = 'C2' AND (missing IN (4, 5) OR run IN (2, 3))")
    m, r = F.col("missing"), F.col("run")
    return e.select("video_id", "eligible", P.edge_reasons((m == 4, "AT_COUNT"), (m == 5, "JUST_OVER_COUNT"), (r == 2, "AT_RUN"), (r == 3, "JUST_OVER_RUN")).alias("reason"))


_NEAREST = """near AS (SELECT f.video_id, f.split, f.slot, f.available, (SELECT arg_min(g.slot, abs(g.slot - f.slot) * 1000 + g.slot) FROM frames g WHERE g.video_id = f.video_id AND g.available) AS source_slot FROM frames f)"""


@query(f"""WITH {T.USERS}, {_F32}, {_NEAREST} SELECT video_id, slot, source_slot, abs(slot - source_slot) AS distance FROM near""")
def nearest_valid_slots(spark: SparkSession, d: str) -> DataFrame:
    return S.nearest_valid(T.frames(spark, d, 32), ["video_id"], "slot", F.col("available")).select("video_id", "slot", "source_slot", "distance")


@query(f"""WITH {T.USERS}, {_F32}, {_NEAREST} SELECT n.video_id, n.slot, n.source_slot, abs(n.slot - n.source_slot) AS distance, abs(n.slot - n.source_slot) > 0 AS imputed, round(s.avg_value, 6) AS avg_value, round(s.max_value, 6) AS max_value
FROM near n LEFT JOIN frames s ON s.video_id = n.video_id AND s.slot = n.source_slot""")
def context_sequences(spark: SparkSession, d: str) -> DataFrame:
    s = S.substitute(T.frames(spark, d, 32), ["video_id"], "slot", F.col("available"), ["avg_value", "max_value"])
    return s.select("video_id", "slot", "source_slot", "distance", "imputed", F.round("avg_value", 6).alias("avg_value"), F.round("max_value", 6).alias("max_value"))


@query(f"""WITH {T.USERS}, {_F32}, {_NEAREST}, x AS (SELECT split, abs(slot - source_slot) AS v FROM near WHERE NOT available AND source_slot IS NOT NULL)
SELECT split, count(*) AS n, min(v)::DOUBLE AS min, round(avg(v), 9) AS mean, round(stddev_pop(v), 9) AS std, quantile_cont(v, 0.5)::DOUBLE AS median, quantile_cont(v, 0.9)::DOUBLE AS p90, quantile_cont(v, 0.95)::DOUBLE AS p95, max(v)::DOUBLE AS max FROM x GROUP BY split""")
def imputation_distances(spark: SparkSession, d: str) -> DataFrame:
    n = S.nearest_valid(T.frames(spark, d, 32), ["video_id"], "slot", F.col("available")).where("NOT available AND source_slot IS NOT NULL")
    s = D.summarize(n, ["split"], F.col("distance"), (50, 90, 95))
    return s.withColumns({"mean": F.round("mean", 9), "std": F.round("std", 9)})


@query(f"""WITH {T.USERS}, {_F32}, {T.state_sql(32)} SELECT split, count(*) AS n, sum(missing)::BIGINT AS imputed, round(avg(missing), 9) AS mean, quantile_cont(missing, 0.5)::DOUBLE AS median, max(missing) AS max, max(run) AS max_run,
  count(*) FILTER (missing = 0) AS b0, count(*) FILTER (missing BETWEEN 1 AND 2) AS b1_2, count(*) FILTER (missing BETWEEN 3 AND 4) AS b3_4, count(*) FILTER (missing BETWEEN 5 AND 8) AS b5_8, count(*) FILTER (missing > 8) AS b9
FROM state GROUP BY split""")
def imputation_by_split(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("missing")
    b = D.buckets(m, (("b0", 0, 0), ("b1_2", 1, 2), ("b3_4", 3, 4), ("b5_8", 5, 8), ("b9", 9, None)))
    return T.state(T.frames(spark, d, 32)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(m).alias("imputed"), F.round(F.avg(m), 9).alias("mean"), F.percentile(m, 0.5).alias("median"), F.max(m).alias("max"), F.max("run").alias("max_run"), *b)


@query(f"""WITH {T.USERS}, {_F32}, p AS (SELECT slot, avg(CASE WHEN available THEN 0 ELSE 1 END) FILTER (split = 'train') AS t, avg(CASE WHEN available THEN 0 ELSE 1 END) FILTER (split = 'val') AS v FROM frames GROUP BY slot)
SELECT slot, round(t, 9) AS train_rate, round(v, 9) AS val_rate, round(v - t, 9) AS difference, CASE WHEN t > 0 THEN round(v / t, 9) END AS ratio FROM p""")
def slot_imputation_frequency(spark: SparkSession, d: str) -> DataFrame:
    f = T.frames(spark, d, 32).withColumn("m", (~F.col("available")).cast("int"))
    rate = lambda s: F.avg(F.when(F.col("split") == s, F.col("m")))
    p = f.groupBy("slot").agg(rate("train").alias("t"), rate("val").alias("v"))
    return p.select("slot", F.round("t", 9).alias("train_rate"), F.round("v", 9).alias("val_rate"), F.round(F.col("v") - F.col("t"), 9).alias("difference"), F.round(F.try_divide("v", "t"), 9).alias("ratio"))


@query(f"""WITH {T.USERS}, {_F32}, {_NEAREST} SELECT video_id, source_slot, count(*) AS uses, list(slot ORDER BY slot) AS targets FROM near WHERE source_slot IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1""")
def source_reuse(spark: SparkSession, d: str) -> DataFrame:
    n = S.nearest_valid(T.frames(spark, d, 32), ["video_id"], "slot", F.col("available")).where("source_slot IS NOT NULL")
    return n.groupBy("video_id", "source_slot").agg(F.count(F.lit(1)).alias("uses"), F.array_sort(F.collect_list("slot")).alias("targets")).where("uses > 1")


@query(f"""WITH {T.USERS}, {_F32}, {T.state_sql(32)} SELECT v.value, count(s.video_id) AS n FROM (SELECT unnest(range(0, 9)) AS value) v LEFT JOIN state s ON s.missing = v.value AND {_REASON} = 'NONE' GROUP BY v.value""")
def imputed_count_histogram(spark: SparkSession, d: str) -> DataFrame:
    s = T.state(T.frames(spark, d, 32))
    kept = s.where(P.exclusion_reason(F.col("valid"), F.col("missing") > 8, F.col("run") > 4) == "NONE")
    return D.dense_histogram(kept, F.col("missing"), 0, 8)


@query(f"""WITH {T.USERS}, n AS (SELECT user_id AS video_id, count(*) AS n FROM events GROUP BY 1), g AS (SELECT video_id, n, (20 + video_id % 11)::DOUBLE AS fps, unnest(range(0, 40)) AS slot FROM users JOIN n USING (video_id))
SELECT video_id, slot::INTEGER AS slot, slot / 4.0::DOUBLE AS target, CAST(floor(slot / 4.0::DOUBLE * fps + 0.5::DOUBLE) AS BIGINT) AS source_index,
  list_contains(list_transform(range(0, 8), lambda i: CAST(floor(i * (n - 1) / 7.0::DOUBLE + 0.5::DOUBLE) AS INTEGER)), slot) AS selected, slot = n // 2 AS middle FROM g""")
def canonical_grid(spark: SparkSession, d: str) -> DataFrame:
    """For every video of the table the slots, target seconds, nearest source row at its own rate,
    and which slots are picked evenly from as many as it has events."""
    n = table(spark, d, "events").groupBy(F.col("user_id").alias("video_id")).agg(F.count(F.lit(1)).alias("n"))
    v = T.users(spark, d).join(n, "video_id").withColumn("fps", (20 + F.col("video_id") % 11).cast("double"))
    g = v.select("video_id", "n", "fps", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("slot"))
    g = g.join(F.broadcast(S.slot_grid(spark, 40, 4.0)), "slot")  # 40 rows
    picked, middle = S.even_positions(F.col("n"), 8), S.even_positions(F.col("n"), 1)
    return g.select("video_id", "slot", "target", S.source_index(F.col("target"), F.col("fps")).alias("source_index"), F.array_contains(picked, F.col("slot")).alias("selected"), F.array_contains(middle, F.col("slot")).alias("middle"))


@query(f"""WITH {T.USERS}, {_F32}, {_NEAREST} SELECT video_id, slot, CASE WHEN abs(slot - source_slot) <= 2 THEN source_slot END AS hint FROM near WHERE NOT available""")
def near_hints(spark: SparkSession, d: str) -> DataFrame:
    return S.near_hint(T.frames(spark, d, 32), ["video_id"], "slot", ~F.col("available"), F.col("available"), 2).select("video_id", "slot", "hint")
