"""Distributions, correlations, losses, metrics and epoch series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import classify as L
from seqloom.operators import distribution as D
from seqloom.operators import sampling as M
from seqloom.operators import statistics as C
from seqloom.operators.joins import first_by
from seqloom.operators.ordering import with_average_rank
from seqloom.operators.rollup import ratio, value_counts
from seqloom.operators.sets import pairwise_overlap
from seqloom.sources.readers import table

from . import twins as T
from ._register import query


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_STATS = ["min", "mean", "std", "p01", "p05", "median", "p75", "p90", "p95", "p99", "max"]


def _stats_sql(v: str) -> str:
    q = lambda p: f"round(quantile_cont({v}, {p}), 6)"
    return f"count({v}) AS n, round(min({v})::DOUBLE, 6) AS min, round(avg({v}), 6) AS mean, round(stddev_pop({v}), 6) AS std, {q(0.01)} AS p01, {q(0.05)} AS p05, {q(0.5)} AS median, {q(0.75)} AS p75, {q(0.9)} AS p90, {q(0.95)} AS p95, {q(0.99)} AS p99, round(max({v})::DOUBLE, 6) AS max"


@query(f"SELECT event_type, {_stats_sql('value')} FROM events GROUP BY event_type")
def value_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(D.summarize(table(spark, d, "events"), ["event_type"], F.col("value")), *_STATS)


@query(f"""WITH u AS (UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME metric VALUE value)
SELECT l_returnflag, metric, {_stats_sql('value')} FROM u GROUP BY 1, 2""")
def metric_distributions(spark: SparkSession, d: str) -> DataFrame:
    m = D.long_form(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return _rounded(D.summarize(m, ["l_returnflag", "metric"], F.col("value")), *_STATS)


def _rank_sql(v: str, g: str) -> str:
    return f"rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g}, {v}) - 1) / 2.0::DOUBLE"


@query(f"""WITH r AS (SELECT l_returnflag, l_quantity AS a, l_extendedprice AS b, {_rank_sql('l_quantity', 'l_returnflag')} AS ra, {_rank_sql('l_extendedprice', 'l_returnflag')} AS rb FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY l_returnflag""")
def paired_correlations(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.correlations(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]), "pearson", "spearman")


@query("""SELECT c_mktsegment, 0::DOUBLE AS constant, count(*) AS n, NULL::DOUBLE AS r FROM customer GROUP BY c_mktsegment""")
def constant_correlation(spark: SparkSession, d: str) -> DataFrame:
    """A constant side has no correlation: null, not an error."""
    c = table(spark, d, "customer").withColumn("k", F.lit(0.0))
    return c.groupBy("c_mktsegment").agg(F.first("k").alias("constant"), F.count(F.lit(1)).alias("n"), C.pearson(F.col("c_acctbal"), F.col("k")).alias("r"))


@query(f"""SELECT s_suppkey, {_rank_sql('s_nationkey', 's_nationkey % 2')} AS rank_1, {_rank_sql('s_nationkey', 's_nationkey % 2')} - 1 AS rank_0 FROM supplier""")
def average_ranks(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").withColumn("g", F.pmod("s_nationkey", F.lit(2)))
    return with_average_rank(with_average_rank(s, "s_nationkey", ["g"], "rank_1"), "s_nationkey", ["g"], "rank_0", base=0).select("s_suppkey", "rank_1", "rank_0")


_CONFUSION = """c AS (SELECT g, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y = 0 AND p = 1) AS fp, count(*) FILTER (y = 1 AND p = 0) AS fn, count(*) FILTER (y = 1 AND p = 1) AS tp FROM x GROUP BY g)
SELECT g, tn, fp, fn, tp, tn + fp + fn + tp AS n, round((tn + tp) / (tn + fp + fn + tp)::DOUBLE, 9) AS accuracy,
  round((coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0) + coalesce(2 * tn / nullif(2 * tn + fp + fn, 0)::DOUBLE, 0)) / 2, 9) AS macro_f1,
  round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 9) AS "precision", round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 9) AS f1 FROM c"""
_METRICS = ("accuracy", "macro_f1", "precision", "recall", "f1")


@query(f"WITH x AS (SELECT doc_id % 4 AS g, quality AS y, toxic AS p FROM labels), {_CONFUSION}")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").withColumn("g", F.pmod("doc_id", F.lit(4)))
    return _rounded(C.confusion(x, F.col("quality"), F.col("toxic"), ["g"]), *_METRICS, digits=9)


def losses(spark: SparkSession, d: str) -> DataFrame:
    s = T.scored(spark, d)
    return s.withColumn("r", C.two_class(F.col("l0"), F.col("l1"), F.col("label"))).select("*", "r.*").drop("r")


@query(f"WITH {T.SCORED} SELECT sample, label, prediction, round(exp(l0 - ls), 6) AS p0, round(exp(l1 - ls), 6) AS p1, round(loss, 6) AS loss, round(confidence, 6) AS confidence, prediction = label AS correct FROM losses")
def sample_losses(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(losses(spark, d).select("sample", "label", "prediction", "p0", "p1", "loss", "confidence", "correct"), "p0", "p1", "loss", "confidence")


@query(f"WITH {T.SCORED} SELECT grp, count(*) AS n, round(avg(loss), 6) AS mean_loss, round(avg(CASE WHEN prediction = label THEN 1.0 ELSE 0 END), 9) AS accuracy FROM losses GROUP BY grp")
def inference_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = losses(spark, d).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("loss").alias("mean_loss"), F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return _rounded(_rounded(m, "mean_loss"), "accuracy", digits=9)


@query(f"""WITH {T.SCORED}, r AS (SELECT loss, row_number() OVER (ORDER BY round(loss, 9) DESC, sample) AS rn, count(*) OVER () AS n, sum(loss) OVER () AS s FROM losses),
t AS (SELECT * FROM (VALUES ('top_5', 5.0, 0.0), ('top_10', 10.0, 0.0), ('top_20', 20.0, 0.0), ('top_10_percent', 0.0, 0.1), ('top_20_percent', 0.0, 0.2)) AS t(top, k, f))
SELECT top, CAST(CASE WHEN any_value(f) > 0 THEN ceil(any_value(n) * any_value(f)) ELSE any_value(k) END AS BIGINT) AS "rows", round(sum(loss) FILTER (rn <= CASE WHEN f > 0 THEN ceil(n * f) ELSE k END), 4) AS loss,
  round(sum(loss) FILTER (rn <= CASE WHEN f > 0 THEN ceil(n * f) ELSE k END) / any_value(s), 6) AS share FROM r CROSS JOIN t GROUP BY top""")
def loss_concentration(spark: SparkSession, d: str) -> DataFrame:
    c = M.concentration_of_top(losses(spark, d), "loss", (("top_5", 5), ("top_10", 10), ("top_20", 20), ("top_10_percent", 0.1), ("top_20_percent", 0.2)))
    return _rounded(_rounded(c, "loss", digits=4), "share")


@query(f"""WITH {T.SCORED}, a AS (SELECT 'loss' AS list, sample, row_number() OVER (ORDER BY round(loss, 9) DESC, sample)::INTEGER AS rank FROM losses QUALIFY rank <= 20),
b AS (SELECT 'confident_error' AS list, sample, row_number() OVER (ORDER BY round(confidence, 9) DESC, sample)::INTEGER AS rank FROM losses WHERE prediction <> label QUALIFY rank <= 20)
SELECT * FROM a UNION ALL SELECT * FROM b""")
def hard_samples(spark: SparkSession, d: str) -> DataFrame:
    x = losses(spark, d)
    a = M.top_k(x, [F.round("loss", 9).desc(), F.col("sample")], 20).select(F.lit("loss").alias("list"), "sample", "rank")
    b = M.top_k(x.where("NOT correct"), [F.round("confidence", 9).desc(), F.col("sample")], 20).select(F.lit("confident_error").alias("list"), "sample", "rank")
    return a.unionByName(b)


@query(f"""WITH {T.SCORED}, a AS (SELECT sample, row_number() OVER (ORDER BY round(loss, 9) DESC, sample) AS ra FROM losses QUALIFY ra <= 200),
b AS (SELECT sample, row_number() OVER (ORDER BY round(l1 - l0, 9) DESC, sample) AS rb FROM losses QUALIFY rb <= 200)
SELECT a.sample, ra::INTEGER AS rank_loss, rb::INTEGER AS rank_margin FROM a JOIN b ON a.sample = b.sample""")
def shared_hard_samples(spark: SparkSession, d: str) -> DataFrame:
    """The intersection of two top lists."""
    x = losses(spark, d)
    a = M.top_k(x, [F.round("loss", 9).desc(), F.col("sample")], 200).select("sample", F.col("rank").alias("rank_loss"))
    b = M.top_k(x, [F.round(F.col("l1") - F.col("l0"), 9).desc(), F.col("sample")], 200).select("sample", F.col("rank").alias("rank_margin"))
    return a.join(b, "sample")


@query(f"""WITH {T.SCORED}, g AS (SELECT 'correct' AS relation, CASE WHEN prediction = label THEN 'yes' ELSE 'no' END AS grp, loss FROM losses UNION ALL SELECT 'label', CAST(label AS VARCHAR), loss FROM losses)
SELECT relation, grp, count(*) AS n, round(avg(loss), 6) AS mean, round(quantile_cont(loss, 0.5), 6) AS median FROM g GROUP BY 1, 2""")
def loss_relations(spark: SparkSession, d: str) -> DataFrame:
    x = losses(spark, d)
    pairs = F.array(F.struct(F.lit("correct").alias("relation"), F.when(F.col("correct"), "yes").otherwise("no").alias("grp")), F.struct(F.lit("label").alias("relation"), F.col("label").cast("string").alias("grp")))
    g = D.summarize(x.select(F.explode(pairs).alias("p"), "loss").select("p.*", "loss"), ["relation", "grp"], F.col("loss"), (50,))
    return _rounded(g.select("relation", "grp", "n", "mean", "median"), "mean", "median")


_EPOCHS = """e AS (SELECT event_type AS run, dayofmonth(ts)::BIGINT AS epoch, round(avg(value), 6) AS loss FROM events WHERE month(ts) = 1 GROUP BY 1, 2)"""


def epochs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where(F.month("ts") == 1)
    return e.groupBy(F.col("event_type").alias("run"), F.dayofmonth("ts").cast("long").alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))


@query(f"""WITH {_EPOCHS}, s AS (SELECT *, abs(loss - lag(loss) OVER (PARTITION BY run ORDER BY epoch)) AS step FROM e)
SELECT run, round(avg(step), 6) AS mean_step, round(max(step), 6) AS max_step, round(stddev_samp(loss), 6) AS std, min(loss) AS best, arg_min(epoch, loss * 1e6 + epoch * 1e-3) AS best_epoch, arg_max(loss, epoch) AS final FROM s GROUP BY run""")
def epoch_stability(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(C.epoch_series(epochs(spark, d), "run", "epoch", "loss"), "mean_step", "max_step", "std")


@query(f"""WITH {_EPOCHS}, b AS (SELECT *, loss < coalesce(min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS better FROM e),
g AS (SELECT *, sum(CASE WHEN better THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY epoch) AS grp FROM b),
w AS (SELECT *, row_number() OVER (PARTITION BY run, grp ORDER BY epoch) - 1 AS wait FROM g),
s AS (SELECT run, min(epoch) FILTER (wait >= 5) AS stop_epoch FROM w GROUP BY run)
SELECT s.run, s.stop_epoch, max(w.epoch) FILTER (better) AS best_epoch, min(w.loss) AS best FROM s JOIN w ON w.run = s.run AND w.epoch <= coalesce(s.stop_epoch, 1000) GROUP BY s.run, s.stop_epoch""")
def early_stopping(spark: SparkSession, d: str) -> DataFrame:
    return C.early_stop(epochs(spark, d), "run", "epoch", "loss", patience=5)


@query(f"""WITH {_EPOCHS}, p AS (SELECT a.epoch % 3 AS seed, a.loss - b.loss AS diff FROM e a JOIN e b ON a.epoch = b.epoch AND a.run = 'view' AND b.run = 'click')
SELECT seed, count(*) AS n, round(avg(diff), 6) AS mean, round(stddev_samp(diff), 6) AS std FROM p GROUP BY seed""")
def paired_differences(spark: SparkSession, d: str) -> DataFrame:
    """Differences of two runs at the same epochs, with the sample deviation."""
    e = epochs(spark, d)
    a, b = e.where("run = 'view'").select("epoch", F.col("loss").alias("a")), e.where("run = 'click'").select("epoch", F.col("loss").alias("b"))
    p = a.join(b, "epoch").select(F.pmod("epoch", F.lit(3)).alias("seed"), (F.col("a") - F.col("b")).alias("diff"))
    return _rounded(p.groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.avg("diff").alias("mean"), F.stddev_samp("diff").alias("std")), "mean", "std")


@query("""WITH w AS (SELECT p_brand, p_partkey, p_retailprice AS v, min(p_retailprice) OVER b AS lo, max(p_retailprice) OVER b AS hi FROM part WINDOW b AS (PARTITION BY p_brand))
SELECT p_partkey, round(coalesce((v - lo) / nullif(hi - lo, 0), 0), 9) AS score FROM w""")
def min_max_scores(spark: SparkSession, d: str) -> DataFrame:
    return C.min_max(table(spark, d, "part"), "p_retailprice", ["p_brand"], "score").select("p_partkey", F.round("score", 9).alias("score"))


@query("""WITH f AS (SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS label, count(DISTINCT o_orderpriority) > 1 AS conflicting FROM orders GROUP BY o_custkey)
SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 9) AS share, count(*) FILTER (conflicting) AS conflicting FROM f GROUP BY label""")
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The first label of each unit, its share, and units with several labels."""
    f = table(spark, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderpriority", "o_orderkey").alias("label"), (F.count_distinct("o_orderpriority") > 1).alias("conflicting"))
    n = f.count()
    return f.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("conflicting").alias("conflicting")).withColumn("share", F.round(ratio(F.col("n"), F.lit(n)), 9))


@query("""WITH x AS (SELECT DISTINCT o_orderpriority AS g, o_custkey AS k FROM orders) SELECT p.g AS a, q.g AS b, count(*) AS n FROM x p JOIN x q ON p.k = q.k AND p.g < q.g GROUP BY 1, 2""")
def split_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return pairwise_overlap(table(spark, d, "orders"), "o_orderpriority", "o_custkey")


@query("""SELECT l_returnflag, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS weighted_mean FROM lineitem GROUP BY l_returnflag""")
def weighted_means(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(C.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 6).alias("weighted_mean"))


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, rank FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber)::INTEGER AS rank FROM lineitem) WHERE rank <= 10""")
def group_outliers(spark: SparkSession, d: str) -> DataFrame:
    return M.top_k(table(spark, d, "lineitem"), [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 10, ["l_returnflag"]).select("l_returnflag", "l_orderkey", "l_linenumber", "rank")


@query("""WITH u AS (UNPIVOT (SELECT o_orderstatus, o_orderpriority FROM orders) ON o_orderstatus, o_orderpriority INTO NAME "column" VALUE value) SELECT "column", value, count(*) AS n FROM u GROUP BY 1, 2""")
def value_count_table(spark: SparkSession, d: str) -> DataFrame:
    return value_counts(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"])


@query(f"""WITH {T.SCORED}, a AS (SELECT count(*) AS n, count(*) FILTER (prediction <> label AND label = 1) AS missed, count(*) FILTER (prediction <> label AND label = 0) AS false_alarms, avg(confidence) AS conf FROM losses)
SELECT n, missed, false_alarms, CASE WHEN (CASE WHEN missed > 2 * false_alarms THEN 1 ELSE 0 END + CASE WHEN false_alarms > 2 * missed THEN 1 ELSE 0 END + CASE WHEN conf >= 0.8 THEN 1 ELSE 0 END) = 0 THEN 'BALANCED'
  WHEN (CASE WHEN missed > 2 * false_alarms THEN 1 ELSE 0 END + CASE WHEN false_alarms > 2 * missed THEN 1 ELSE 0 END + CASE WHEN conf >= 0.8 THEN 1 ELSE 0 END) > 1 THEN 'MIXED'
  WHEN missed > 2 * false_alarms THEN 'MISSES' WHEN false_alarms > 2 * missed THEN 'FALSE_ALARMS' ELSE 'OVERCONFIDENT' END AS result FROM a""")
def error_pattern(spark: SparkSession, d: str) -> DataFrame:
    """A rule over one row of aggregates."""
    wrong = ~F.col("correct")
    a = losses(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong & (F.col("label") == 1)).alias("missed"), F.count_if(wrong & (F.col("label") == 0)).alias("false_alarms"), F.avg("confidence").alias("conf"))
    m, f = F.col("missed"), F.col("false_alarms")
    return a.select("n", "missed", "false_alarms", L.one_of([(m > 2 * f, "MISSES"), (f > 2 * m, "FALSE_ALARMS"), (F.col("conf") >= 0.8, "OVERCONFIDENT")], "BALANCED", "MIXED").alias("result"))


@query("""SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def first_of_each(spark: SparkSession, d: str) -> DataFrame:
    return first_by(table(spark, d, "orders"), ["o_orderpriority"], [F.col("o_orderkey")]).select("o_orderpriority", "o_orderkey", "o_totalprice")
