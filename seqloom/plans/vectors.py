"""Feature vectors: clip statistics, temporal variation, shifts, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import vectors as V
from seqloom.operators import classify as L
from seqloom.operators import statistics as C
from seqloom.operators.distribution import share
from seqloom.operators.moments import element_moments
from seqloom.sources.readers import packed, table

from . import twins as T
from ._register import query


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {T.CLIPS}, f AS (SELECT clip, slot, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l2, list_sum(v) AS s, list_sum(list_transform(v, lambda x: x * x)) AS ss FROM clips)
SELECT clip, round(sum(s) / 2048, 6) AS mean, round(sqrt(greatest(0, sum(ss) / 2048 - (sum(s) / 2048) * (sum(s) / 2048))), 6) AS std, round(avg(l2), 6) AS l2_mean, round(quantile_cont(l2, 0.5), 6) AS l2_median, round(min(l2), 6) AS l2_min, round(max(l2), 6) AS l2_max FROM f GROUP BY clip""")
def clip_statistics(spark: SparkSession, d: str) -> DataFrame:
    f = T.clips(spark, d).select("clip", V.l2(F.col("v")).alias("l2"), (V.mean(F.col("v")) * F.size("v")).alias("s"), V.dot(F.col("v"), F.col("v")).alias("ss"), F.size("v").alias("k"))
    m = F.sum("s") / F.sum("k")
    g = f.groupBy("clip").agg(m.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.sum("ss") / F.sum("k") - m * m)).alias("std"), F.avg("l2").alias("l2_mean"), F.percentile("l2", 0.5).alias("l2_median"), F.min("l2").alias("l2_min"), F.max("l2").alias("l2_max"))
    return _r(g, "mean", "std", "l2_mean", "l2_median", "l2_min", "l2_max")


_STEPS = """p AS (SELECT clip, split, slot, v, lag(v) OVER (PARTITION BY clip ORDER BY slot) AS u FROM clips),
s AS (SELECT clip, split, slot, sqrt(list_sum(list_transform(list_zip(u, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS l2, greatest(-1, least(1, list_inner_product(u, v) / (sqrt(list_inner_product(u, u)) * sqrt(list_inner_product(v, v))))) AS cos FROM p WHERE u IS NOT NULL)"""


def steps(spark: SparkSession, d: str) -> DataFrame:
    p = T.clips(spark, d).withColumn("u", F.lag("v").over(Window.partitionBy("clip").orderBy("slot"))).where("u IS NOT NULL")
    return p.select("clip", "split", "slot", V.l2_distance(F.col("u"), F.col("v")).alias("l2"), V.cosine(F.col("u"), F.col("v")).alias("cos"))


@query(f"""WITH {T.CLIPS}, {_STEPS} SELECT clip, count(*) AS n, round(avg(l2), 6) AS l2_mean, round(quantile_cont(l2, 0.5), 6) AS l2_median, round(max(l2), 6) AS l2_max, round(avg(cos), 6) AS cos_mean, round(quantile_cont(cos, 0.5), 6) AS cos_median, round(min(cos), 6) AS cos_min FROM s GROUP BY clip""")
def temporal_variation(spark: SparkSession, d: str) -> DataFrame:
    g = steps(spark, d).groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.avg("l2").alias("l2_mean"), F.percentile("l2", 0.5).alias("l2_median"), F.max("l2").alias("l2_max"), F.avg("cos").alias("cos_mean"), F.percentile("cos", 0.5).alias("cos_median"), F.min("cos").alias("cos_min"))
    return _r(g, "l2_mean", "l2_median", "l2_max", "cos_mean", "cos_median", "cos_min")


@query(f"""WITH {T.CLIPS}, e AS (SELECT a.clip, a.v AS u, b.v AS v FROM clips a JOIN clips b ON a.clip = b.clip AND a.slot = 0 AND b.slot = 31)
SELECT clip, round(sqrt(list_sum(list_transform(list_zip(u, v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))), 6) AS start_end_l2, round(list_inner_product(u, v) / (sqrt(list_inner_product(u, u)) * sqrt(list_inner_product(v, v))), 6) AS start_end_cos FROM e""")
def start_to_end(spark: SparkSession, d: str) -> DataFrame:
    e = T.clips(spark, d).where("slot IN (0, 31)").groupBy("clip").agg(F.min_by("v", "slot").alias("u"), F.max_by("v", "slot").alias("v"))
    return _r(e.select("clip", V.l2_distance(F.col("u"), F.col("v")).alias("start_end_l2"), V.cosine(F.col("u"), F.col("v")).alias("start_end_cos")), "start_end_l2", "start_end_cos")


@query(f"""WITH {T.CLIPS}, {_STEPS} SELECT split, count(*) AS n, round(avg(CASE WHEN cos >= 0.1 THEN 1.0 ELSE 0 END), 9) AS ge_10, round(avg(CASE WHEN cos >= 0.2 THEN 1.0 ELSE 0 END), 9) AS ge_20, round(avg(CASE WHEN cos >= 0.95 THEN 1.0 ELSE 0 END), 9) AS ge_95 FROM s GROUP BY split""")
def near_duplicate_steps(spark: SparkSession, d: str) -> DataFrame:
    return steps(spark, d).groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[F.round(share(F.col("cos") >= t), 9).alias(n) for n, t in (("ge_10", 0.1), ("ge_20", 0.2), ("ge_95", 0.95))])


@query(f"""WITH {T.CLIPS}, {_STEPS} SELECT split, slot, round(avg(l2), 6) AS l2_mean, round(quantile_cont(cos, 0.5), 6) AS cos_median FROM s GROUP BY 1, 2""")
def step_profile(spark: SparkSession, d: str) -> DataFrame:
    return _r(steps(spark, d).groupBy("split", "slot").agg(F.avg("l2").alias("l2_mean"), F.percentile("cos", 0.5).alias("cos_median")), "l2_mean", "cos_median")


_SHIFT = """x AS (SELECT split, unnest(v) AS x, unnest(range(0, 64)) AS dim FROM clips),
g AS (SELECT dim, avg(x) FILTER (split = 'train') AS mean_a, stddev_pop(x) FILTER (split = 'train') AS std_a, avg(x) FILTER (split = 'val') AS mean_b, stddev_pop(x) FILTER (split = 'val') AS std_b FROM x GROUP BY dim)"""


def shift(spark: SparkSession, d: str) -> DataFrame:
    return C.dimension_shift(T.clips(spark, d), "v", "split", "train", "val")


@query(f"""WITH {T.CLIPS}, {_SHIFT} SELECT dim::INTEGER AS dim, round(mean_a, 6) AS mean_a, round(std_a, 6) AS std_a, round(mean_b, 6) AS mean_b, round(std_b, 6) AS std_b, round(abs(mean_b - mean_a) / (std_a + 1e-12), 6) AS shift FROM g""")
def dimension_shifts(spark: SparkSession, d: str) -> DataFrame:
    return _r(shift(spark, d), "mean_a", "std_a", "mean_b", "std_b", "shift")


@query(f"""WITH {T.CLIPS}, {_SHIFT} SELECT round(sum(mean_a * mean_b) / (sqrt(sum(mean_a * mean_a)) * sqrt(sum(mean_b * mean_b))), 6) AS cosine, round(sqrt(sum((mean_a - mean_b) * (mean_a - mean_b))), 6) AS l2 FROM g""")
def mean_vectors(spark: SparkSession, d: str) -> DataFrame:
    return _r(C.mean_vector_comparison(shift(spark, d)), "cosine", "l2")


@query(f"""WITH {T.CLIPS}, {_SHIFT}, s AS (SELECT abs(mean_b - mean_a) / (std_a + 1e-12) AS shift, mean_a, mean_b FROM g),
a AS (SELECT quantile_cont(shift, 0.95) AS p95, sum(mean_a * mean_b) / (sqrt(sum(mean_a * mean_a)) * sqrt(sum(mean_b * mean_b))) AS cosine FROM s)
SELECT round(p95, 6) AS p95, round(cosine, 6) AS cosine, CASE CASE WHEN p95 >= 0.5 THEN 1 ELSE 0 END + CASE WHEN cosine < 0.99 THEN 1 ELSE 0 END WHEN 0 THEN 'STABLE' WHEN 1 THEN 'POSSIBLE_SHIFT' ELSE 'SHIFT' END AS result FROM a""")
def feature_shift_class(spark: SparkSession, d: str) -> DataFrame:
    s = shift(spark, d)
    a = s.agg(F.percentile("shift", 0.95).alias("p95"), F.try_divide(F.sum(F.col("mean_a") * F.col("mean_b")), F.sqrt(F.sum(F.col("mean_a") * F.col("mean_a"))) * F.sqrt(F.sum(F.col("mean_b") * F.col("mean_b")))).alias("cosine"))
    result = L.graded([F.col("p95") >= 0.5, F.col("cosine") < 0.99], ["STABLE", "POSSIBLE_SHIFT", "SHIFT"])
    return a.select(F.round("p95", 6).alias("p95"), F.round("cosine", 6).alias("cosine"), result.alias("result"))


@query("""WITH e AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings) SELECT label, count(*) AS n, sum(len(list_filter(v, lambda x: isnan(x))))::BIGINT AS nan, sum(len(list_filter(v, lambda x: isinf(x))))::BIGINT AS inf, sum(len(list_filter(v, lambda x: x = 0)))::BIGINT AS zero,
  count(*) FILTER (len(list_filter(v, lambda x: x <> 0)) = 0) AS all_zero, count(*) FILTER (len(v) <> 64) AS wrong_size FROM e GROUP BY label""")
def array_checks(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("b", V.bad_counts(F.col("embedding")))
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("b.nan").alias("nan"), F.sum("b.inf").alias("inf"), F.sum("b.zero").alias("zero"), F.count_if(V.all_zero(F.col("embedding"))).alias("all_zero"), F.count_if(F.size("embedding") != 64).alias("wrong_size"))


@query("""WITH h AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings), e AS (SELECT vec_id, a, CASE WHEN vec_id % 3 = 0 THEN list_transform(a, lambda v, i: CASE WHEN i = 6 THEN v + 0.0000005::DOUBLE ELSE v END) ELSE b END AS b FROM h), d AS (SELECT vec_id, a, b, list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2])) AS d FROM e)
SELECT vec_id, round(list_max(d), 6) AS max_abs, round(list_sum(d) / 32, 6) AS mean_abs, round((list_sort(d)[16] + list_sort(d)[17]) / 2, 6) AS median_abs, round(sqrt(list_sum(list_transform(d, lambda x: x * x)) / 32), 6) AS rmse,
  round(list_max(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]) / greatest(abs(z[1]), 1.1754943508222875e-38::DOUBLE))), 4) AS max_relative, len(list_filter(d, lambda x: x > 0))::BIGINT AS nonzero, list_max(d) = 0 AS exact, len(list_filter(list_zip(a, b), lambda z: abs(z[1] - z[2]) > 1e-6 + 1e-5 * abs(z[2]))) = 0 AS close,
  len(list_filter(list_zip(a, b), lambda z: abs(z[1] - z[2]) > 1e-6 + 1e-5 * abs(z[2])))::BIGINT AS failed, array_to_string(list_transform([1e-6::DOUBLE, 1e-5::DOUBLE, 1e-4::DOUBLE], lambda r: CASE WHEN len(list_filter(list_zip(a, b), lambda z: abs(z[1] - z[2]) > r / 10 + r * abs(z[2]))) = 0 THEN 'pass' ELSE 'fail' END), ',') AS tolerances FROM d""")
def version_differences(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a vector (here the two halves) compared element by element."""
    e = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    e = e.withColumn("b", F.when(F.col("vec_id") % 3 == 0, F.transform("a", lambda v, i: F.when(i == 5, v + F.lit(0.0000005)).otherwise(v))).otherwise(F.col("b").cast("array<double>")))
    x = e.select("vec_id", V.difference_stats(F.col("a").cast("array<double>"), F.col("b")).alias("s")).select("vec_id", "s.*")
    x = x.withColumn("tolerances", F.array_join(F.transform("tolerances", lambda t: F.when(t["pass"], "pass").otherwise("fail")), ","))
    return _r(_r(x, "max_relative", digits=4), "max_abs", "mean_abs", "median_abs", "rmse")


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, count(*) AS n, round(sum(x), 4) AS total, round(min(x), 6) AS min, round(max(x), 6) AS max, round(avg(x), 6) AS mean, round(var_pop(x), 6) AS variance FROM e GROUP BY label""")
def moment_state(spark: SparkSession, d: str) -> DataFrame:
    """Moments whose partial states of any number of tasks merge, without sums of squares, which
    lose all digits of a small variance around a large mean."""
    g = element_moments(table(spark, d, "embeddings").select("label", "embedding"), ["label"], "embedding")
    return _r(_r(g, "total", digits=4), "min", "max", "mean", "variance")


@query(f"""WITH {T.USERS}, {T.frames_sql(32)}, m AS (SELECT video_id, list(available ORDER BY slot) AS a, list(n_events > 1 ORDER BY slot) AS b FROM frames GROUP BY video_id)
SELECT video_id, len(list_filter(list_zip(a, b), lambda z: z[1] <> z[2]))::BIGINT AS mismatches, len(list_filter(list_zip(a, b), lambda z: z[1] AND z[2]))::BIGINT AS both FROM m""")
def mask_comparison(spark: SparkSession, d: str) -> DataFrame:
    f = T.frames(spark, d, 32).withColumn("b", F.col("n_events") > 1)
    m = packed(f, ["video_id"], "slot", ["available", "b"])
    both = V.and_masks(F.col("available"), F.col("b"))
    return m.select("video_id", V.mismatches(F.col("available"), F.col("b")).alias("mismatches"), F.size(F.filter(both, lambda x: x)).cast("long").alias("both"))


@query(f"""WITH {T.USERS}, {T.frames_sql(32)}, {T.runs_sql('available')} SELECT u.video_id, coalesce(max(r.length), 0)::INTEGER AS longest FROM users u LEFT JOIN runs r ON r.video_id = u.video_id GROUP BY u.video_id""")
def longest_valid_in_mask(spark: SparkSession, d: str) -> DataFrame:
    """The longest run from a packed mask, without a window."""
    m = packed(T.frames(spark, d, 32), ["video_id"], "slot", ["available"])
    return m.select("video_id", V.longest_true(F.col("available")).alias("longest"))


@query("""WITH e AS (SELECT vec_id, label, list_transform(embedding[1:8]::DOUBLE[], lambda x: round((x / 255.0::DOUBLE - 0.485::DOUBLE) / 0.229::DOUBLE, 6)) AS scaled FROM embeddings) SELECT vec_id, scaled FROM e""")
def scaled_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.transform(V.scaled(F.slice("embedding", 1, 8), 0.485, 0.229), lambda x: F.round(x, 6)).alias("scaled"))
