"""Observation tables derived from the fixture tables, in Spark and as SQL for the oracle.

An observed unit ("video") is a user of ``events``; its slots are equal stretches of the 30
days from 2024-01-01; a slot is available if the user has an event in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.resample import on_grid
from seqloom.sources.readers import table

DAYS = 30


def split_of(user: Column) -> Column:
    return F.when(F.pmod(user, F.lit(5)) == 0, "val").otherwise("train")


def label_of(user: Column) -> Column:
    return F.when(F.pmod(F.floor(user / 5), F.lit(2)) == 0, "pos").otherwise("neg")


def seconds(ts: Column) -> Column:
    """Seconds since 2024-01-01, whatever the session's time zone."""
    day = F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date"))
    return (day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def users(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "events").select(F.col("user_id").alias("video_id")).distinct()
    return u.withColumns({"split": split_of(F.col("video_id")), "label": label_of(F.col("video_id"))})


def observed(spark: SparkSession, d: str, slots: int) -> DataFrame:
    e = table(spark, d, "events").withColumn("sec", seconds(F.col("ts"))).where(F.col("sec").between(0, DAYS * 86400 - 1))
    e = e.withColumn("slot", F.floor(F.col("sec") * slots / (DAYS * 86400)).cast("int"))
    return e.groupBy(F.col("user_id").alias("video_id"), "slot").agg(F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("avg_value"), F.max("value").alias("max_value"), F.min("sec").alias("first_sec"))


def frames(spark: SparkSession, d: str, slots: int) -> DataFrame:
    g = on_grid(users(spark, d), observed(spark, d, slots), ["video_id"], slots)
    return g.withColumns({"available": F.col("n_events").isNotNull(), "n_events": F.coalesce("n_events", F.lit(0))})


def clips(spark: SparkSession, d: str) -> DataFrame:
    """Whole clips of 32 vectors: clip, slot, split, v (double array)."""
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 32).cast("long").alias("clip"), F.pmod("vec_id", F.lit(32)).cast("int").alias("slot"), F.col("embedding").cast("array<double>").alias("v"), "label")
    whole = e.groupBy("clip").agg(F.count(F.lit(1)).alias("n")).where("n = 32").select("clip")
    return e.join(whole, "clip").withColumn("split", F.when(F.pmod("clip", F.lit(3)) == 0, "val").otherwise("train"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Orders as scored samples: sample, grp, label, l0, l1."""
    o = table(spark, d, "orders")
    x = F.col("o_totalprice")
    return o.select(
        F.col("o_orderkey").alias("sample"),
        F.col("o_orderpriority").alias("grp"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        ((x - 200000.0) / 100000.0).alias("l0"),
        ((F.pmod("o_custkey", F.lit(100)) - 50) / 25.0).cast("double").alias("l1"),
    )


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Line items as two boxes in a 640 x 480 frame, and an angle."""
    from seqloom.functions.geometry import box

    li = table(spark, d, "lineitem")
    x, y = F.pmod("l_partkey", F.lit(560)), F.pmod(F.col("l_suppkey") * 7, F.lit(400))
    w, h = F.col("l_quantity").cast("long") * 3 + 20, F.pmod("l_orderkey", F.lit(90)) + 30
    dx, dy = F.pmod("l_orderkey", F.lit(17)) - 8, F.pmod("l_partkey", F.lit(13)) - 6
    angle = (F.pmod(F.col("l_orderkey") * 37 + F.col("l_linenumber"), F.lit(720)) - 360).cast("double")
    return li.select("l_orderkey", "l_linenumber", box(x, y, x + w, y + h).alias("a"), box(x + dx, y + dy, x + dx + w, y + dy + h).alias("b"), angle.alias("angle"))


USERS = """users AS (SELECT DISTINCT user_id AS video_id, CASE WHEN user_id % 5 = 0 THEN 'val' ELSE 'train' END AS split,
  CASE WHEN (user_id // 5) % 2 = 0 THEN 'pos' ELSE 'neg' END AS label FROM events)"""


def frames_sql(slots: int, name: str = "frames") -> str:
    sec = "date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 86400 + hour(ts) * 3600 + minute(ts) * 60 + second(ts)"
    return f"""{name}_o AS (SELECT user_id AS video_id, CAST(sec * {slots} // {DAYS * 86400} AS INTEGER) AS slot, count(*) AS n_events, avg(value) AS avg_value, max(value) AS max_value, min(sec) AS first_sec
  FROM (SELECT *, {sec} AS sec FROM events) WHERE sec BETWEEN 0 AND {DAYS * 86400 - 1} GROUP BY 1, 2),
{name} AS (SELECT u.video_id, u.split, u.label, s.slot, o.n_events IS NOT NULL AS available, coalesce(o.n_events, 0) AS n_events, o.avg_value, o.max_value, o.first_sec
  FROM users u CROSS JOIN (SELECT unnest(range(0, {slots}))::INTEGER AS slot) s LEFT JOIN {name}_o o ON o.video_id = u.video_id AND o.slot = s.slot)"""


def runs_sql(member: str, name: str = "runs", frames: str = "frames") -> str:
    return f"""{name}_i AS (SELECT video_id, split, label, slot, first_sec, slot - row_number() OVER (PARTITION BY video_id ORDER BY slot) AS island FROM {frames} WHERE {member}),
{name} AS (SELECT video_id, min(slot) AS start, max(slot) AS "end", count(*) AS length, row_number() OVER (PARTITION BY video_id ORDER BY min(slot)) AS run_id FROM {name}_i GROUP BY video_id, island)"""


def state_sql(slots: int, frames: str = "frames", name: str = "state") -> str:
    """Per video: valid, missing, run (longest missing)."""
    return f"""{runs_sql('NOT available', f'{name}_r', frames)},
{name} AS (SELECT f.video_id, f.split, f.label, count(*) FILTER (available) AS valid, count(*) FILTER (NOT available) AS missing, coalesce(any_value(r.run), 0) AS run
  FROM {frames} f LEFT JOIN (SELECT video_id, max(length) AS run FROM {name}_r GROUP BY video_id) r ON r.video_id = f.video_id GROUP BY ALL)"""


def state(frames_: DataFrame) -> DataFrame:
    from seqloom.operators.runs import run_summary

    s = run_summary(frames_, ["video_id", "split", "label"], "slot", ~F.col("available"))
    return s.select("video_id", "split", "label", (F.col("n_slots") - F.col("n_member")).alias("valid"), F.col("n_member").alias("missing"), F.col("longest_run").alias("run"))


CLIPS = """clips AS (SELECT vec_id // 32 AS clip, CAST(vec_id % 32 AS INTEGER) AS slot, embedding::DOUBLE[] AS v, label, CASE WHEN (vec_id // 32) % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM embeddings
  WHERE vec_id // 32 IN (SELECT vec_id // 32 FROM embeddings GROUP BY 1 HAVING count(*) = 32))"""
SCORED = """scored_i AS (SELECT o_orderkey AS sample, o_orderpriority AS grp, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label, (o_totalprice - 200000.0::DOUBLE) / 100000.0::DOUBLE AS l0, ((o_custkey % 100) - 50) / 25.0::DOUBLE AS l1 FROM orders),
scored AS (SELECT *, greatest(l0, l1) + ln(exp(l0 - greatest(l0, l1)) + exp(l1 - greatest(l0, l1))) AS ls, CASE WHEN l1 > l0 THEN 1 ELSE 0 END AS prediction FROM scored_i),
losses AS (SELECT *, ls - CASE WHEN label = 1 THEN l1 ELSE l0 END AS loss, greatest(exp(l0 - ls), exp(l1 - ls)) AS confidence FROM scored)"""
BOXES = """boxes_i AS (SELECT l_orderkey, l_linenumber, l_partkey % 560 AS ax1, (l_suppkey * 7) % 400 AS ay1, CAST(l_quantity AS BIGINT) * 3 + 20 AS w, l_orderkey % 90 + 30 AS h,
  l_orderkey % 17 - 8 AS dx, l_partkey % 13 - 6 AS dy, ((l_orderkey * 37 + l_linenumber) % 720 - 360)::DOUBLE AS angle FROM lineitem),
boxes AS (SELECT *, ax1 + w AS ax2, ay1 + h AS ay2, ax1 + dx AS bx1, ay1 + dy AS by1, ax1 + dx + w AS bx2, ay1 + dy + h AS by2 FROM boxes_i)"""
