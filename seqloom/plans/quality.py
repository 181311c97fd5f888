"""Missing-slot quality: runs, rollups, histograms, concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import distribution as D
from seqloom.operators import rollup as R
from seqloom.operators import runs as W
from seqloom.operators.frames import distinct_below
from seqloom.operators.sampling import top_k

from seqloom.sources.readers import table

from . import twins as T
from ._register import query

_F32, _F100 = T.frames_sql(32), T.frames_sql(100)


def missing():
    return ~F.col("available")


@query(f"""WITH {T.USERS}, {_F32}, {T.runs_sql('NOT available')}
SELECT video_id, run_id::INTEGER AS run_id, start, "end", length FROM runs""")
def missing_runs(spark: SparkSession, d: str) -> DataFrame:
    return W.runs(T.frames(spark, d, 32), ["video_id"], "slot", missing()).select("video_id", "run_id", "start", "end", "length")


@query(f"""WITH {T.USERS}, {_F32}, {T.runs_sql('available')}
SELECT video_id, max(length) AS longest, count(*) AS n_runs, min(start) AS first_start FROM runs GROUP BY video_id""")
def valid_runs(spark: SparkSession, d: str) -> DataFrame:
    """The same operator with the other membership."""
    r = W.runs(T.frames(spark, d, 32), ["video_id"], "slot", F.col("available"))
    return r.groupBy("video_id").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("n_runs"), F.min("start").alias("first_start"))


@query(f"""WITH {T.USERS}, {_F100}, {T.runs_sql('NOT available')},
r AS (SELECT video_id, count(*) AS n_runs, max(length) AS longest_run FROM runs GROUP BY video_id)
SELECT f.video_id, f.split, f.label, count(*) AS n_slots, count(*) FILTER (NOT available) AS n_missing, coalesce(any_value(n_runs), 0) AS n_runs, coalesce(any_value(longest_run), 0) AS longest_run,
  min(slot) FILTER (NOT available) AS first_missing, max(slot) FILTER (NOT available) AS last_missing,
  coalesce(min(slot) FILTER (NOT available) = 0, false) AS touches_start, coalesce(max(slot) FILTER (NOT available) = 99, false) AS touches_end
FROM frames f LEFT JOIN r ON r.video_id = f.video_id GROUP BY f.video_id, f.split, f.label""")
def video_quality(spark: SparkSession, d: str) -> DataFrame:
    s = W.run_summary(T.frames(spark, d, 100), ["video_id", "split", "label"], "slot", missing())
    return s.withColumnsRenamed({"n_member": "n_missing", "first": "first_missing", "last": "last_missing"})


@query(f"""WITH {T.USERS}, {_F100}, {T.state_sql(100)}
SELECT split, label, CASE WHEN grouping(split) = 0 AND grouping(label) = 0 THEN 'split*label' WHEN grouping(split) = 0 THEN 'split' WHEN grouping(label) = 0 THEN 'label' ELSE 'overall' END AS group_type,
  count(*) AS n_videos, sum(missing)::BIGINT AS missing, sum(valid)::BIGINT AS valid, round(sum(missing) / sum(missing + valid)::DOUBLE, 9) AS missing_rate, max(run) AS longest_run
FROM state GROUP BY CUBE (split, label)""")
def quality_cube(spark: SparkSession, d: str) -> DataFrame:
    s = T.state(T.frames(spark, d, 100))
    c = R.cube(s, ["split", "label"], [F.count(F.lit(1)).alias("n_videos"), F.sum("missing").alias("missing"), F.sum("valid").alias("valid"), F.max("run").alias("longest_run")])
    return c.withColumn("missing_rate", F.round(R.ratio(F.col("missing"), F.col("missing") + F.col("valid")), 9))


@query(f"""WITH {T.USERS}, {_F100}, {T.state_sql(100)}
SELECT split, label, CASE WHEN grouping(split) = 0 AND grouping(label) = 0 THEN 'split*label' WHEN grouping(split) = 0 THEN 'split' ELSE 'label' END AS group_type, count(*) AS n, sum(valid)::BIGINT AS valid
FROM state GROUP BY GROUPING SETS ((split), (label), (split, label))""")
def sequence_summary_sets(spark: SparkSession, d: str) -> DataFrame:
    return R.grouping_sets(T.state(T.frames(spark, d, 100)), [["split"], ["label"], ["split", "label"]], [F.count(F.lit(1)).alias("n"), F.sum("valid").alias("valid")])


@query(f"""WITH {T.USERS}, {_F100} SELECT slot, count(*) AS n, count(*) FILTER (NOT available) AS missing, round(avg(CASE WHEN available THEN 0 ELSE 1 END), 9) AS rate FROM frames GROUP BY slot""")
def slot_missing_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.frames(spark, d, 100).groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.count_if(missing()).alias("missing"), F.round(D.share(missing()), 9).alias("rate"))


@query(f"""WITH {T.USERS}, {_F100}
SELECT CASE WHEN slot < 10 THEN 'first_10' WHEN slot < 90 THEN 'middle_80' ELSE 'last_10' END AS period, count(*) AS n, count(*) FILTER (NOT available) AS missing, round(avg(CASE WHEN available THEN 0 ELSE 1 END), 9) AS rate FROM frames GROUP BY 1""")
def period_missing_rates(spark: SparkSession, d: str) -> DataFrame:
    period = F.when(F.col("slot") < 10, "first_10").when(F.col("slot") < 90, "middle_80").otherwise("last_10")
    return T.frames(spark, d, 100).groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count_if(missing()).alias("missing"), F.round(D.share(missing()), 9).alias("rate"))


@query(f"""WITH {T.USERS}, {_F100}, {T.state_sql(100)} SELECT v.value, count(s.video_id) AS n FROM (SELECT unnest(range(0, 101)) AS value) v LEFT JOIN state s ON s.missing = v.value GROUP BY v.value""")
def missing_histogram(spark: SparkSession, d: str) -> DataFrame:
    return D.dense_histogram(T.state(T.frames(spark, d, 100)), F.col("missing"), 0, 100)


@query(f"""WITH {T.USERS}, {_F100}, {T.state_sql(100)} SELECT v."limit", count(s.video_id) AS at_most, round(count(s.video_id) / (SELECT count(*) FROM state)::DOUBLE, 9) AS share
FROM (SELECT unnest(range(0, 101)) AS "limit") v LEFT JOIN state s ON s.missing <= v."limit" GROUP BY v."limit" """)
def missing_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return D.cumulative_counts(T.state(T.frames(spark, d, 100)), F.col("missing"), 100).withColumn("share", F.round("share", 9))


@query(f"""WITH {T.USERS}, {_F32}, {T.state_sql(32)},
r AS (SELECT missing, row_number() OVER (ORDER BY missing DESC, video_id) AS rn, count(*) OVER () AS n FROM state)
SELECT p AS percent, count(*) FILTER (rn <= ceil(n * p / 100.0)) AS n_top, round(coalesce(sum(missing) FILTER (rn <= ceil(n * p / 100.0)), 0) / sum(missing)::DOUBLE, 9) AS share
FROM r CROSS JOIN (SELECT unnest([1, 5, 10]) AS p) GROUP BY p""")
def missing_concentration(spark: SparkSession, d: str) -> DataFrame:
    return D.concentration(T.state(T.frames(spark, d, 32)), F.col("missing")).withColumn("share", F.round("share", 9))


@query(f"""WITH {T.USERS}, {_F32}, {T.runs_sql('NOT available')} SELECT v.value, count(r.video_id) AS n FROM (SELECT unnest(range(1, 33)) AS value) v LEFT JOIN runs r ON r.length = v.value GROUP BY v.value""")
def run_length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return D.dense_histogram(W.runs(T.frames(spark, d, 32), ["video_id"], "slot", missing()), F.col("length"), 1, 32)


@query(f"""WITH {T.USERS}, {_F32}, {T.runs_sql('NOT available')},
n AS (SELECT video_id, slot, last_value(avg_value IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY slot ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b,
  first_value(avg_value IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS a FROM frames)
SELECT r.video_id, r.start, r."end", round(x.b, 6) AS value_before, round(y.a, 6) AS value_after
FROM runs r JOIN n x ON x.video_id = r.video_id AND x.slot = r.start JOIN n y ON y.video_id = r.video_id AND y.slot = r."end" """)
def run_neighbours(spark: SparkSession, d: str) -> DataFrame:
    f = T.frames(spark, d, 32)
    near = W.neighbours(f, ["video_id"], "slot", "avg_value", 5)
    r = W.runs(f, ["video_id"], "slot", missing())
    before = near.select("video_id", F.col("slot").alias("start"), F.round("value_before", 6).alias("value_before"))
    after = near.select("video_id", F.col("slot").alias("end"), F.round("value_after", 6).alias("value_after"))
    return r.join(before, ["video_id", "start"]).join(after, ["video_id", "end"]).select("video_id", "start", "end", "value_before", "value_after")


@query(f"""WITH {T.USERS}, {_F32}, {T.runs_sql('available')},
t AS (SELECT r.video_id, r.run_id, max(f.first_sec) - min(f.first_sec) AS span FROM runs r JOIN frames f ON f.video_id = r.video_id AND f.slot BETWEEN r.start AND r."end" GROUP BY 1, 2)
SELECT video_id, max(span) AS longest_span, sum(span)::BIGINT AS total_span FROM t GROUP BY video_id""")
def run_spans(spark: SparkSession, d: str) -> DataFrame:
    """Time from the first to the last observation of each run; 0 for a single slot."""
    r = W.runs(T.frames(spark, d, 32), ["video_id"], "slot", F.col("available"), [(F.max("first_sec") - F.min("first_sec")).alias("span")])
    return r.groupBy("video_id").agg(F.max("span").alias("longest_span"), F.sum("span").alias("total_span"))


@query(f"""WITH {T.USERS}, {_F100}, {T.state_sql(100)} SELECT count(*) FILTER (missing = 0) AS complete, count(*) FILTER (valid = 0) AS empty, count(*) FILTER (missing >= 50) AS half_missing, count(*) FILTER (run >= 5) AS run_5, count(*) FILTER (run >= 10) AS run_10, count(*) FILTER (missing > 0 AND run = 1) AS single_slots FROM state""")
def quality_extremes(spark: SparkSession, d: str) -> DataFrame:
    m, v, r = F.col("missing"), F.col("valid"), F.col("run")
    return T.state(T.frames(spark, d, 100)).agg(F.count_if(m == 0).alias("complete"), F.count_if(v == 0).alias("empty"), F.count_if(m >= 50).alias("half_missing"), F.count_if(r >= 5).alias("run_5"), F.count_if(r >= 10).alias("run_10"), F.count_if((m > 0) & (r == 1)).alias("single_slots"))


@query(f"""WITH {T.USERS}, {_F100}, {T.state_sql(100)} SELECT video_id, missing, run, row_number() OVER (ORDER BY missing DESC, run DESC, video_id)::INTEGER AS rank FROM state QUALIFY rank <= 50""")
def most_missing_top50(spark: SparkSession, d: str) -> DataFrame:
    return top_k(T.state(T.frames(spark, d, 100)), [F.desc("missing"), F.desc("run"), F.col("video_id")], 50).select("video_id", "missing", "run", "rank")


@query(f"""WITH {T.USERS}, {_F32}, l AS (SELECT split, available, lag(available) OVER (PARTITION BY video_id ORDER BY slot) AS p FROM frames),
t AS (SELECT split, CASE WHEN p THEN 'valid' ELSE 'missing' END || '_to_' || CASE WHEN available THEN 'valid' ELSE 'missing' END AS transition FROM l WHERE p IS NOT NULL)
SELECT s.split, x.transition, count(t.transition) AS n FROM (SELECT unnest(['train', 'val']) AS split) s CROSS JOIN (SELECT unnest(['valid_to_valid', 'valid_to_missing', 'missing_to_valid', 'missing_to_missing']) AS transition) x
LEFT JOIN t ON t.split = s.split AND t.transition = x.transition GROUP BY 1, 2""")
def mask_transitions(spark: SparkSession, d: str) -> DataFrame:
    t = W.transitions(T.frames(spark, d, 32), ["video_id"], "slot", "available", ("valid", "missing"))
    counts = t.groupBy("split", "transition").agg(F.count(F.lit(1)).alias("n"))
    spine = spark.createDataFrame([(s, f"{a}_to_{b}") for s in ("train", "val") for a in ("valid", "missing") for b in ("valid", "missing")], "split string, transition string")
    return R.zero_filled(counts, spine, ["split", "transition"], ["n"])


@query(f"""WITH {T.USERS}, {_F32}, l AS (SELECT video_id, max_value < lag(max_value) OVER (PARTITION BY video_id ORDER BY slot) AS bad FROM frames WHERE available)
SELECT video_id, count(*) FILTER (bad) AS violations FROM l GROUP BY video_id""")
def order_violations(spark: SparkSession, d: str) -> DataFrame:
    return W.monotone(T.frames(spark, d, 32).where("available"), ["video_id"], "slot", "max_value")


@query("""WITH o AS (SELECT o_orderstatus, o_orderkey AS slot, o_totalprice FROM orders), i AS (SELECT *, slot - row_number() OVER (PARTITION BY o_orderstatus ORDER BY slot) AS island FROM o),
r AS (SELECT o_orderstatus, min(slot) AS start, max(slot) AS "end", count(*) AS length, round(sum(o_totalprice), 2) AS price FROM i GROUP BY o_orderstatus, island) SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY start) AS run_id FROM r""")
def long_key_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of neighbouring order keys of one status: a few keys that hold the whole table."""
    from seqloom.operators.long_runs import long_runs

    o = table(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return long_runs(o, ["o_orderstatus"], "o_orderkey", F.lit(True), {"price": F.col("o_totalprice")}, 64).withColumn("price", F.round("price", 2))


@query("""WITH l AS (SELECT o_orderstatus, o_totalprice < lag(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS bad FROM orders) SELECT o_orderstatus, count(*) FILTER (bad) AS violations FROM l GROUP BY o_orderstatus""")
def long_key_order(spark: SparkSession, d: str) -> DataFrame:
    from seqloom.operators.long_runs import long_monotone

    return long_monotone(table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", "o_totalprice", block=64)


@query(f"""WITH {T.USERS}, {_F100} SELECT video_id, sum(n_events - 1)::BIGINT AS excess, count(*) FILTER (n_events > 1) AS shared_slots FROM frames WHERE available GROUP BY video_id""")
def shared_slot_excess(spark: SparkSession, d: str) -> DataFrame:
    return T.frames(spark, d, 100).where("available").groupBy("video_id").agg(F.sum(F.col("n_events") - 1).alias("excess"), F.count_if(F.col("n_events") > 1).alias("shared_slots"))


@query(f"""WITH {T.USERS}, {_F100}, g AS (SELECT video_id, split, label, count(*) AS n, min(slot) AS low, max(slot) AS high, count(DISTINCT slot) AS dist FROM frames GROUP BY 1, 2, 3)
SELECT split, count(*) AS n_videos, count(*) FILTER (n <> 100) AS wrong_rows, count(*) FILTER (low <> 0 OR high <> 99) AS wrong_range, count(*) FILTER (dist <> n) AS repeated_slots FROM g GROUP BY split""")
def frame_scan_checks(spark: SparkSession, d: str) -> DataFrame:
    g = T.frames(spark, d, 100).groupBy("video_id", "split", "label").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), distinct_below(F.col("slot"), 100).alias("dist"))
    return g.groupBy("split").agg(F.count(F.lit(1)).alias("n_videos"), F.count_if(F.expr("n <> 100")).alias("wrong_rows"), F.count_if(F.expr("low <> 0 OR high <> 99")).alias("wrong_range"), F.count_if(F.expr("dist <> n")).alias("repeated_slots"))
