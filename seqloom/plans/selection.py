"""Deterministic samples for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.scalars import labels
from seqloom.operators import sampling as M
from seqloom.operators.ordering import percentiles
from seqloom.sources.readers import batches, table

from . import twins as T
from ._register import query

_F100 = T.frames_sql(100)


@query("""SELECT o_orderpriority, o_orderkey, turn::INTEGER AS turn FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS turn FROM orders) ORDER BY turn, o_orderpriority LIMIT 50""")
def round_robin_sample(spark: SparkSession, d: str) -> DataFrame:
    return M.round_robin(table(spark, d, "orders"), ["o_orderpriority"], [F.col("o_orderkey")], 50).select("o_orderpriority", "o_orderkey", "turn")


@query("""WITH r AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority, o_orderkey FROM r WHERE list_contains(list_transform(range(0, 5), lambda j: CAST(floor(j * (n - 1) / 4.0::DOUBLE + 0.5) AS BIGINT)), i)""")
def evenly_spaced_sample(spark: SparkSession, d: str) -> DataFrame:
    return M.evenly_spaced(table(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey"], 5).select("o_orderpriority", "o_orderkey")


@query("""SELECT o_orderpriority, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 3""")
def first_of_stratum(spark: SparkSession, d: str) -> DataFrame:
    return M.top_k(table(spark, d, "orders"), [F.col("o_orderkey")], 3, ["o_orderpriority", "o_orderstatus"]).select("o_orderpriority", "o_orderkey")


@query(f"""WITH {T.USERS}, {_F100}, {T.state_sql(100)},
a AS (SELECT video_id FROM state ORDER BY missing DESC, video_id LIMIT 8), b AS (SELECT video_id FROM state WHERE video_id NOT IN (SELECT video_id FROM a) ORDER BY run DESC, video_id LIMIT 8),
c AS (SELECT video_id FROM state WHERE video_id NOT IN (SELECT video_id FROM a UNION ALL SELECT video_id FROM b) ORDER BY missing, video_id LIMIT 6)
SELECT video_id, 'MOST_MISSING' AS reason FROM a UNION ALL SELECT video_id, 'LONGEST_RUN' FROM b UNION ALL SELECT video_id, 'NORMAL' FROM c""")
def review_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Quotas of several reasons, no unit twice."""
    s = T.state(T.frames(spark, d, 100))
    yes = F.lit(True)
    picked = M.without_reuse(s, "video_id", [("MOST_MISSING", yes, [F.desc("missing"), F.col("video_id")], 8), ("LONGEST_RUN", yes, [F.desc("run"), F.col("video_id")], 8), ("NORMAL", yes, [F.col("missing"), F.col("video_id")], 6)])
    return picked.select("video_id", "reason")


@query(f"""WITH {T.USERS}, {_F100}, {T.state_sql(100)}, {T.runs_sql('NOT available')}, c AS (SELECT video_id FROM state ORDER BY missing DESC, video_id LIMIT 12), z AS (SELECT * FROM c UNION ALL SELECT -1),
b AS (SELECT video_id, arg_min(start, (-length, start)) AS s, arg_min("end", (-length, start)) AS e FROM runs GROUP BY video_id)
SELECT z.video_id, s AS representative_start, e AS representative_end, CASE WHEN s IS NULL THEN '0;50;99' ELSE array_to_string(list_sort(list_distinct([greatest(0, s - 1), s, (s + e) // 2, e, least(99, e + 1)])), ';') END AS recommended_frames FROM z LEFT JOIN b ON b.video_id = z.video_id""")
def review_frames(spark: SparkSession, d: str) -> DataFrame:
    """Chosen videos with the run that stands for them and the frames to look at."""
    from seqloom.operators.review import with_review_frames
    from seqloom.operators.runs import runs

    f = T.frames(spark, d, 100)
    chosen = M.top_k(T.state(f), [F.desc("missing"), F.col("video_id")], 12).select("video_id").unionByName(spark.sql("SELECT -1L AS video_id"))
    return with_review_frames(chosen, runs(f, ["video_id"], "slot", ~F.col("available")))


_PRIORITY = "CASE WHEN l_quantity > 40 THEN 100 ELSE 0 END + CASE WHEN l_discount >= 0.08 THEN 40 ELSE 0 END + CASE WHEN l_tax = 0 THEN 30 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 15 ELSE 0 END"


@query(f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, {_PRIORITY} AS score FROM lineitem) SELECT score, count(*) AS n, min(l_orderkey) AS first_order FROM s GROUP BY score""")
def priority_scores(spark: SparkSession, d: str) -> DataFrame:
    add = lambda c, n: F.when(F.expr(c), n).otherwise(0)
    score = add("l_quantity > 40", 100) + add("l_discount >= 0.08", 40) + add("l_tax = 0", 30) + add("l_returnflag = 'R'", 15)
    return table(spark, d, "lineitem").groupBy(score.alias("score")).agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_order"))


@query("""WITH c AS (SELECT unnest(list_filter([CASE WHEN l_quantity > 40 THEN 'large' END, CASE WHEN l_discount >= 0.08 THEN 'discounted' END, CASE WHEN l_tax = 0 THEN 'untaxed' END], lambda x: x IS NOT NULL)) AS category, l_returnflag FROM lineitem)
SELECT category, l_returnflag, count(*) AS n FROM c GROUP BY 1, 2""")
def visual_categories(spark: SparkSession, d: str) -> DataFrame:
    c = labels((F.col("l_quantity") > 40, "large"), (F.col("l_discount") >= 0.08, "discounted"), (F.col("l_tax") == 0, "untaxed"))
    return table(spark, d, "lineitem").select(F.explode(c).alias("category"), "l_returnflag").groupBy("category", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT vec_id, vec_id // 64 AS batch, vec_id % 64 AS position FROM embeddings""")
def ordered_batches(spark: SparkSession, d: str) -> DataFrame:
    return batches(table(spark, d, "embeddings").select("vec_id"), "vec_id", 64)


@query("""SELECT b AS batch, least(64, (SELECT count(*) FROM embeddings) - b * 64) AS n FROM (SELECT unnest(range(0, CAST(ceil((SELECT count(*) FROM embeddings) / 64.0) AS BIGINT))) AS b)""")
def shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of seeded batches: every row stands in exactly one."""
    b = batches(table(spark, d, "embeddings").select("vec_id"), "vec_id", 64, seed=3)
    return b.groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {T.USERS}, {_F100}, {T.state_sql(100)}, m AS (SELECT quantile_cont(missing, 0.5) AS a, quantile_cont(run, 0.5) AS b FROM state)
SELECT video_id, missing, run FROM state, m WHERE missing <= a AND run <= b""")
def normal_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Units at or below every metric's median."""
    s = T.state(T.frames(spark, d, 100))
    a, b = (percentiles(s, [], F.col(c), [("median", 0.5)]).first()["median"] for c in ("missing", "run"))  # two numbers
    return s.where((F.col("missing") <= a) & (F.col("run") <= b)).select("video_id", "missing", "run")
