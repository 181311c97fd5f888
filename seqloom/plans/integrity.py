"""Constraints, reconciliation, profiling, parsing and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions import scalars as S
from seqloom.operators import integrity as I
from seqloom.operators import text as X
from seqloom.sources import readers as R
from seqloom.sources.readers import table
from seqloom.streaming.rolling import rolling_windows

from . import twins as T
from ._register import query

_RULES = (("BIG_DISCOUNT", "l_discount >= 0.09"), ("NO_TAX", "l_tax = 0"), ("QUANTITY_RANGE", "l_quantity > 45"), ("FLAG_STATUS", "l_returnflag = 'N' AND l_linestatus = 'F'"), ("NEVER", "l_quantity < 0"))


def _rules() -> list:
    return [(code, F.expr(c)) for code, c in _RULES]


@query("WITH v AS (SELECT l_orderkey, l_linenumber, unnest(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{code}' END" for code, c in _RULES) + "], lambda x: x IS NOT NULL)) AS rule FROM lineitem) SELECT * FROM v")
def rule_violations(spark: SparkSession, d: str) -> DataFrame:
    return I.violations(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _rules())


@query(" UNION ALL ".join(f"SELECT '{code}' AS rule, count(*) FILTER ({c}) AS n FROM lineitem" for code, c in _RULES))
def rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return I.violation_counts(table(spark, d, "lineitem"), _rules())


@query("""WITH a AS (SELECT l_returnflag AS name, count(*) AS value FROM lineitem GROUP BY 1), b AS (SELECT l_returnflag AS name, count(*) AS value FROM lineitem WHERE l_quantity > 0 AND NOT (l_returnflag = 'R' AND l_quantity = 50) GROUP BY 1)
SELECT name, a.value AS "left", b.value AS "right", a.value IS NOT DISTINCT FROM b.value AS equal FROM a FULL JOIN b USING (name)""")
def reconciled_totals(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    n = lambda x: x.groupBy(F.col("l_returnflag").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return I.reconcile_totals(n(li), n(li.where("l_quantity > 0 AND NOT (l_returnflag = 'R' AND l_quantity = 50)")))


@query("""SELECT count(*) AS n, min(vec_id) AS low, max(vec_id) AS high, count(DISTINCT vec_id) AS "distinct", min(vec_id) = 0 AND max(vec_id) = count(*) - 1 AND count(DISTINCT vec_id) = count(*) AS dense FROM embeddings""")
def dense_index(spark: SparkSession, d: str) -> DataFrame:
    return I.dense_order(table(spark, d, "embeddings"), "vec_id")


@query("""SELECT o_orderkey AS item, CASE WHEN o_orderkey % 5 = 0 THEN 'PROCESS' WHEN o_orderkey % 5 = 1 THEN 'CONFLICT_INCOMPLETE' WHEN o_orderkey % 5 = 2 THEN 'CONFLICT_PROVENANCE' WHEN o_orderkey % 5 = 3 THEN 'CONFLICT_INVALID_BUNDLE' ELSE 'SKIP' END AS status FROM orders""")
def resume_states(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"), F.lit("p").alias("policy_hash"), F.lit("s").alias("source_hash"))
    m = F.pmod("item", F.lit(5))
    markers = plan.where(m != 0).select("item", "policy_hash", F.when(m == 2, "other").otherwise("s").alias("source_hash"), F.when(m == 1, F.lit(None).cast("boolean")).otherwise(m != 3).alias("valid"))
    return I.resume_status(plan, markers, "item")


@query("""SELECT (SELECT count(*) FROM lineitem WHERE l_quantity = 50 AND l_tax = 0 AND l_returnflag = 'R') AS unexplained, 0::BIGINT AS absent, (SELECT count(*) FROM lineitem WHERE l_quantity = 50 AND l_tax = 0 AND l_returnflag = 'R') = 0 AS exact""")
def known_exceptions(spark: SparkSession, d: str) -> DataFrame:
    """Whether what differs is exactly what is documented."""
    li = table(spark, d, "lineitem").where("l_quantity = 50 AND l_tax = 0").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey")
    return I.explained(li, li.where("l_returnflag <> 'R'"), ["l_orderkey", "l_linenumber", "l_returnflag", "l_partkey"])


@query("""SELECT o_orderstatus, CASE WHEN count(*) FILTER (o_totalprice < 0) > 0 THEN 'FAILED' WHEN count(*) FILTER (o_totalprice > 400000) > 0 THEN 'WARNINGS' ELSE 'READY' END AS decision FROM orders GROUP BY 1""")
def decisions(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") < 0).alias("f"), F.count_if(F.col("o_totalprice") > 400000).alias("w"))
    return g.select("o_orderstatus", I.decision(F.col("f"), F.col("w")).alias("decision"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) FILTER (trim(coalesce({c}::VARCHAR, '')) = '') AS n_blank, count(DISTINCT {c}) AS n_distinct FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return R.profile(table(spark, d, "nation"))


@query("""SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_quantity, l_discount, l_tax, l_returnflag)""")
def row_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return R.duplicate_rows(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


@query("""SELECT vec_id, vec_id // 16 AS batch, vec_id % 16 AS position, least(16, (SELECT count(*) FROM embeddings) - vec_id // 16 * 16) AS batch_size, (SELECT count(*) FROM embeddings) - vec_id // 16 * 16 < 16 AS partial FROM embeddings""")
def batch_positions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", S.batch_position(F.col("vec_id"), F.lit(e.count()), 16).alias("b")).select("vec_id", "b.*")


_TEXTS = ("True", "false", " TRUE ", "1", "nan", "inf", "2.5", "")


@query(f"""WITH t AS (SELECT event_id, {'CASE event_id % 8 ' + ' '.join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TEXTS)) + ' END'} AS v FROM events)
SELECT v, count(*) AS n, lower(trim(v)) = 'true' AS lenient, CASE WHEN lower(trim(v)) IN ('true', '1') THEN true WHEN lower(trim(v)) IN ('false', '0') THEN false END AS strict_01,
  CASE WHEN v IN ('1', '2.5') THEN v::DOUBLE END AS finite, v = 'inf' AS infinite FROM t GROUP BY v""")
def parsed_scalars(spark: SparkSession, d: str) -> DataFrame:
    v = F.element_at(F.array(*[F.lit(t) for t in _TEXTS]), (F.pmod("event_id", F.lit(8)) + 1).cast("int"))
    g = table(spark, d, "events").select(v.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    c = F.col("v")
    return g.select("v", "n", S.is_true_lenient(c).alias("lenient"), S.is_true_01(c).alias("strict_01"), S.finite(c).alias("finite"), S.is_infinite(c).alias("infinite"))


@query(r"""SELECT p_partkey, replace(lower(trim('  ' || p_brand || '-' || p_type)), '-', '_').regexp_replace('\s+', '_', 'g') AS name, lower(regexp_replace(replace(trim(' ./A\' || p_name), '\', '/'), '^[./]+', '')) AS reference, p_partkey % 2 = 1 AS safe FROM part""")
def normal_names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    path = F.when(F.pmod("p_partkey", F.lit(2)) == 1, F.concat(F.lit("a/"), "p_brand")).otherwise(F.concat(F.lit("../"), "p_brand"))
    return p.select("p_partkey", S.normal_name(F.concat(F.lit("  "), "p_brand", F.lit("-"), "p_type")).alias("name"), S.normal_reference(F.concat(F.lit(" ./A\\"), "p_name")).alias("reference"), S.safe_path(path).alias("safe"))


@query("""WITH c AS (SELECT c_custkey AS k, c_name FROM customer), i AS (SELECT k, c_name, unnest(range(k * 3, k * 3 + 1 + k % 3)) AS n FROM c)
SELECT lpad(n::VARCHAR, greatest(2, length(n::VARCHAR))::INTEGER, '0') AS review_id, CASE k % 4 WHEN 0 THEN true WHEN 1 THEN false END AS verdict, CASE WHEN k % 4 = 3 THEN '' ELSE c_name || chr(10) || 'more words' END AS note FROM i""")
def review_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Sheets of one block a customer, read back: an id or a range of ids, a verdict, a note of
    two lines."""
    k = F.col("c_custkey")
    head = F.concat(F.lit("some title\n\nREVIEW "), k * 3, F.when(k % 3 > 0, F.concat(F.lit("~"), k * 3 + k % 3)).otherwise(""), F.lit("\n"))
    verdict = F.when(k % 4 == 0, "verdict:\nTRUE\n").when(k % 4 == 1, "verdict: FALSE\n").otherwise("verdict: N.A.\n")
    note = F.when(k % 4 == 3, "note:\n\n").otherwise(F.concat(F.lit("note: "), "c_name", F.lit("\nmore words\n\n")))
    b = X.review_blocks(table(spark, d, "customer").select(F.concat(head, verdict, note).alias("sheet")), F.col("sheet"))
    return b.select("review_id", S.review_flag(F.col("fields")["verdict"]).alias("verdict"), F.col("fields")["note"].alias("note"))


@query("""SELECT n_nationkey, n_name, CASE WHEN n_nationkey IN (3, 7) THEN 'checked' ELSE '' END AS verdict FROM nation""")
def prefilled_template(spark: SparkSession, d: str) -> DataFrame:
    known = spark.createDataFrame([(3, "checked"), (7, "checked")], "n_nationkey int, verdict string")
    return X.prefilled(table(spark, d, "nation").select("n_nationkey", "n_name"), known, "n_nationkey", ["verdict"])


@query("""SELECT '{"status":"' || o_orderstatus || '","n":' || count(*) || ',"keys":[' || min(o_orderkey) || ',' || max(o_orderkey) || ']}' AS report FROM orders GROUP BY o_orderstatus""")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    return g.select(F.to_json(F.struct(F.col("o_orderstatus").alias("status"), "n", F.array("a", "b").alias("keys"))).alias("report"))


@query(f"""WITH {T.USERS}, {T.frames_sql(32)}, p AS (SELECT DISTINCT video_id, list(slot ORDER BY slot) AS pattern FROM frames GROUP BY video_id) SELECT count(*) AS n, count(DISTINCT pattern) AS patterns FROM p""")
def slot_pattern(spark: SparkSession, d: str) -> DataFrame:
    p = R.packed(T.frames(spark, d, 32).withColumn("s", F.col("slot")), ["video_id"], "slot", ["s"])
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("patterns"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS t, value FROM events), w AS (SELECT user_id, value, unnest(generate_series((t // 3600000000 - 2) * 3600000000, t // 3600000000 * 3600000000, 3600000000)) AS s, t FROM e)
SELECT user_id, make_timestamp(s) AS start, count(*) AS n, round(max(value), 6) AS max FROM w WHERE t >= s AND t < s + 3 * 3600000000 GROUP BY 1, 2""")
def rolling_activity(spark: SparkSession, d: str) -> DataFrame:
    """Three-hour windows every hour: the batch form of the streaming operator."""
    w = rolling_windows(table(spark, d, "events"), "ts", ["user_id"], "value", "3 hours", "1 hour")
    return w.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("max", 6).alias("max"))


@query("""SELECT md5(string_agg(n_nationkey || ':' || n_name, '|' ORDER BY n_nationkey)) AS h, count(*) AS n FROM nation""")
def ordered_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """The order-sensitive hash of a small relation."""
    rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    return table(spark, d, "nation").agg(F.md5(F.array_join(F.transform(rows, lambda r: F.concat(r["n_nationkey"].cast("string"), F.lit(":"), r["n_name"])), "|")).alias("h"), F.count(F.lit(1)).alias("n"))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS "at", r.rule, r.least, coalesce(CASE r.rule WHEN 'high' THEN value > 40 ELSE event_type = 'click' END, false) AS is_on FROM events, (VALUES ('high', 3600), ('clicks', 0)) AS r(rule, least)),
b AS (SELECT *, coalesce((NOT lag(is_on) OVER w) OR ("at" - lag("at") OVER w) > 86400000000, true) AS is_new FROM e WINDOW w AS (PARTITION BY user_id, rule ORDER BY "at", is_on)),
i AS (SELECT *, sum(is_new::INTEGER) OVER (PARTITION BY user_id, rule ORDER BY "at", is_on ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT user_id, rule, min("at") AS start_us, max("at") AS end_us, count(*) AS frames FROM i WHERE is_on GROUP BY user_id, rule, island, least HAVING max("at") - min("at") >= least::BIGINT * 1000000""")
def lasting_events(spark: SparkSession, d: str) -> DataFrame:
    """Conditions that hold from event to event for long enough (an extension)."""
    from seqloom.streaming.events import Rule
    from seqloom.streaming.events import lasting_events as lasting

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = lasting(e, "user_id", "ts", [Rule("high", "value > 40", 3600.0), Rule("clicks", "event_type = 'click'", 0.0)], gap=86400.0)
    return found.select("user_id", "rule", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "frames")
