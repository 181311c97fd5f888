"""Checked joins, lookups, reconciliation, encoding, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import joins as J
from seqloom.operators import sets as U
from seqloom.operators.rollup import zero_filled
from seqloom.operators.sampling import top_k
from seqloom.sources.readers import table

from . import twins as T
from ._register import query


@query("""SELECT o.o_orderkey, c.c_name, n.n_name, r.r_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""")
def audit_join(spark: SparkSession, d: str) -> DataFrame:
    """A four-way join whose sides must match every row exactly once."""
    n = table(spark, d, "nation").join(table(spark, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_nationkey", "n_name", "r_name")
    c = J.checked_join(table(spark, d, "customer").select(F.col("c_custkey"), "c_name", F.col("c_nationkey").alias("n_nationkey")), n, keys=["n_nationkey"])
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return J.checked_join(o, c, keys=["c_custkey"]).select("o_orderkey", "c_name", "n_name", "r_name")


@query("""WITH k AS (SELECT p_partkey AS left_id, 1 AS priority, s.s_suppkey AS right_id FROM part p JOIN supplier s ON s.s_suppkey = p.p_partkey UNION SELECT p_partkey, 2, s.s_suppkey FROM part p JOIN supplier s ON s.s_nationkey = p.p_size),
one AS (SELECT left_id, priority, min(right_id) AS right_id FROM k GROUP BY 1, 2 HAVING count(DISTINCT right_id) = 1)
SELECT left_id, arg_min(right_id, priority) AS right_id, min(priority)::INTEGER AS priority FROM one GROUP BY left_id""")
def prioritized_match(spark: SparkSession, d: str) -> DataFrame:
    """The best key that finds exactly one row wins; ambiguous keys are passed over."""
    p, s = table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("long")), table(spark, d, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("long"))
    return J.prioritized_lookup(p, "p_partkey", [(1, "p_partkey", s, "s_suppkey", "s_suppkey"), (2, "p_size", s, "s_nationkey", "s_suppkey")])


@query("""SELECT CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'BOTH' WHEN a.k IS NOT NULL THEN 'LEFT_ONLY' WHEN b.k IS NOT NULL THEN 'RIGHT_ONLY' ELSE 'NEITHER' END AS status, count(*) AS n
FROM (SELECT c_custkey AS k FROM customer) u LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') a ON a.k = u.k LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW') b ON b.k = u.k GROUP BY 1""")
def reconciliation(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    r = J.reconcile(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"), ["k"], universe=table(spark, d, "customer").select(F.col("c_custkey").alias("k")))
    return r.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {T.USERS}, {T.frames_sql(32)}, {T.frames_sql(100, 'f100')}, {T.state_sql(32)}, {T.state_sql(100, 'f100', 'st100')},
j AS (SELECT a.split, CASE WHEN a.missing <= 4 AND b.valid >= 40 THEN 'BOTH' WHEN a.missing <= 4 THEN 'CONTEXT_ONLY' WHEN b.valid >= 40 THEN 'BEHAVIOR_ONLY' ELSE 'NEITHER' END AS status FROM state a JOIN st100 b ON a.video_id = b.video_id)
SELECT s.split, x.status, count(j.status) AS n FROM (SELECT unnest(['train', 'val']) AS split) s CROSS JOIN (SELECT unnest(['BOTH', 'CONTEXT_ONLY', 'BEHAVIOR_ONLY', 'NEITHER']) AS status) x LEFT JOIN j ON j.split = s.split AND j.status = x.status GROUP BY 1, 2""")
def branch_status(spark: SparkSession, d: str) -> DataFrame:
    a = T.state(T.frames(spark, d, 32)).where("missing <= 4").select("video_id")
    b = T.state(T.frames(spark, d, 100)).where("valid >= 40").select("video_id")
    u = T.users(spark, d)
    names = ("BOTH", "CONTEXT_ONLY", "BEHAVIOR_ONLY", "NEITHER")
    r = J.reconcile(a, b, ["video_id"], names, universe=u).join(u, "video_id").groupBy("split", "status").agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(r, spark.createDataFrame([(s, n) for s in ("train", "val") for n in names], "split string, status string"), ["split", "status"], ["n"])


@query("""(SELECT l_partkey AS k FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A')""")
def symmetric_difference(spark: SparkSession, d: str) -> DataFrame:
    k = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), "l_returnflag")
    return U.symmetric_difference(k.where("l_returnflag = 'A'").select("k").distinct(), k.where("l_returnflag = 'R'").select("k").distinct())


@query("""SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return U.duplicates(table(spark, d, "orders"), "o_custkey")


@query("""SELECT count(*) AS n, count(DISTINCT k) AS n_keys, count(*) - count(DISTINCT k) AS n_again FROM (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def bag_union(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    whole, _ = U.union_checked("k", o.where("o_orderstatus = 'O'"), o.where("o_orderstatus = 'F'"))
    return whole.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("k").alias("n_keys")).withColumn("n_again", F.col("n") - F.col("n_keys"))


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1 ORDER BY o_orderkey LIMIT 40""")
def ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    return U.first_distinct(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", F.col("o_orderkey"), 40)


@query("""SELECT p_partkey, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part""")
def dictionary_codes(spark: SparkSession, d: str) -> DataFrame:
    coded, _ = J.dictionary_encode(table(spark, d, "part"), "p_type")
    return coded.select("p_partkey", "code")


@query("""SELECT l_orderkey, list(p_retailprice ORDER BY l_linenumber, l_partkey, p_retailprice) AS prices FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def gathered_prices(spark: SparkSession, d: str) -> DataFrame:
    """Values of coded sources gathered to one array for each target, in slot order."""
    li = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("o"), F.col("l_partkey").alias("code"))
    return J.gather(li, table(spark, d, "part").select(F.col("p_partkey").alias("code"), "p_retailprice"), "code", ["l_orderkey"], "o", "p_retailprice", "prices")


@query("""SELECT o_custkey, sum(o_totalprice) FILTER (o_orderstatus = 'O') IS NOT NULL AS has_o, round(min(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS price_O, round(min(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS price_F, count(DISTINCT o_orderstatus) FILTER (o_orderstatus IN ('O', 'F')) = 2 AS complete FROM orders GROUP BY o_custkey""")
def status_pivot(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.min("o_totalprice").alias("price"))
    p = J.pivot_complete(o, "o_custkey", "o_orderstatus", ["O", "F"], ["price"])
    return p.select("o_custkey", F.col("price_O").isNotNull().alias("has_o"), F.round("price_O", 2).alias("price_O"), F.round("price_F", 2).alias("price_F"), "complete")


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def context_only(spark: SparkSession, d: str) -> DataFrame:
    """Units of one set that are not in another: semi and anti joins."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return c.join(o.where("o_orderstatus = 'F'"), "c_custkey", "left_semi").join(o.where("o_orderstatus = 'P'"), "c_custkey", "left_anti")


@query("""WITH a AS (SELECT n_nationkey, n_name FROM nation), b AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3)
SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS only_left, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS only_right, false AS equal""")
def manifest_equality(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation").select("n_nationkey", "n_name")
    return J.same_rows(a, a.where("n_nationkey <> 3"))


@query("""WITH a AS (SELECT c_custkey, c_acctbal, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer), b AS (SELECT o_custkey AS c_custkey, sum(o_totalprice) AS s, row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey) AS rn FROM orders GROUP BY 1)
SELECT a.c_custkey, CASE WHEN a.rn <= 150 AND b.rn <= 150 THEN 'BOTH' WHEN a.rn <= 150 THEN 'BALANCE' ELSE 'ORDERS' END AS category FROM a LEFT JOIN b ON a.c_custkey = b.c_custkey WHERE a.rn <= 150 OR b.rn <= 150""")
def top_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Two top lists and who stands on both."""
    a = top_k(table(spark, d, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], 150).select("c_custkey")
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("s"))
    b = top_k(s, [F.desc("s"), F.col("c_custkey")], 150).select("c_custkey")
    return J.reconcile(a, b, ["c_custkey"], ("BOTH", "BALANCE", "ORDERS", "NEITHER")).withColumnRenamed("status", "category")
