"""Rules over aggregates, reconciliations of several tables, and summaries per clip and split."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import geometry as G
from seqloom.functions import vectors as V
from seqloom.operators import integrity as I
from seqloom.operators import joins as J
from seqloom.operators import resample as Rs
from seqloom.operators import shifts as H
from seqloom.operators.distribution import summarize, summary_columns
from seqloom.operators.ordering import numbered
from seqloom.operators.rollup import cube, ratio
from seqloom.operators.runs import transitions
from seqloom.operators.statistics import correlations
from seqloom.operators.moments import element_moments
from seqloom.sources.readers import table

from . import canonical as C
from . import twins as T
from ._register import query

_F32 = f"{T.USERS}, {T.frames_sql(32)}, {T.state_sql(32)}"
_STATE = """g AS (SELECT split, sum(missing) / (32.0::DOUBLE * count(*)) AS rate, avg((missing > 0)::INTEGER) AS any, quantile_cont(missing, 0.95) AS p95, max(run) AS run FROM state GROUP BY split),
sl AS (SELECT slot, avg((NOT available)::INTEGER) FILTER (split = 'val') - avg((NOT available)::INTEGER) FILTER (split = 'train') AS gap FROM frames GROUP BY slot)"""


@query(f"""WITH {_F32}, {_STATE}, x AS (SELECT v.rate - t.rate AS total_gap, v.any - t.any AS any_gap, v.p95 - t.p95 AS p95_gap, v.run - t.run AS run_gap, (SELECT max(gap) FROM sl) AS slot_gap FROM g v, g t WHERE v.split = 'val' AND t.split = 'train'),
y AS (SELECT *, (total_gap >= 0.01)::INTEGER + (any_gap >= 0.05)::INTEGER + (p95_gap >= 1)::INTEGER + (run_gap >= 1)::INTEGER AS s FROM x)
SELECT round(total_gap, 9) AS total_gap, round(slot_gap, 9) AS slot_gap, CASE WHEN s >= 3 THEN 'POSSIBLE_SEQUENCE_QUALITY_SHIFT' WHEN abs(total_gap) < 0.01 AND slot_gap >= 0.05 THEN 'LOCALIZED_SLOT_SHIFT' WHEN s > 0 OR abs(total_gap) >= 0.005 OR abs(any_gap) >= 0.03 OR slot_gap >= 0.03 THEN 'MIXED' ELSE 'NO_OBVIOUS_SEQUENCE_QUALITY_SHIFT' END AS result FROM y""")
def sequence_shift(spark: SparkSession, d: str) -> DataFrame:
    """Whether imputation shifts between splits."""
    f = T.frames(spark, d, 32)
    s = T.state(f)
    g = s.groupBy("split").agg((F.sum("missing") / (32.0 * F.count(F.lit(1)))).alias("rate"), F.avg((F.col("missing") > 0).cast("double")).alias("any"), F.max("run").alias("run"))
    g = g.join(summarize(s, ["split"], F.col("missing"), (95,)).select("split", "p95"), "split")
    of = lambda c: F.max(F.when(F.col("split") == "val", F.col(c))) - F.max(F.when(F.col("split") == "train", F.col(c)))
    x = g.agg(of("rate").alias("total_gap"), of("any").alias("any_gap"), of("p95").alias("p95_gap"), of("run").alias("run_gap"))
    miss = lambda sp: F.avg(F.when(F.col("split") == sp, (~F.col("available")).cast("double")))
    slots = f.groupBy("slot").agg((miss("val") - miss("train")).alias("gap")).agg(F.max("gap").alias("slot_gap"))
    x = x.join(slots)
    return x.select(F.round("total_gap", 9).alias("total_gap"), F.round("slot_gap", 9).alias("slot_gap"), H.sequence_shift(*[F.col(c) for c in ("total_gap", "any_gap", "p95_gap", "run_gap", "slot_gap")]).alias("result"))


#: Two "models": the halves of a vector; metrics of a clip: mean and length of its vectors.
_MODELS = f"""{T.CLIPS}, h AS (SELECT clip, split, slot, clip % 2 = 0 AS label, v[1:32] AS a, v[33:64] AS b FROM clips), hm AS (SELECT 'a' AS model, clip, split, label, slot, a AS v FROM h UNION ALL SELECT 'b', clip, split, label, slot, b FROM h),
cm AS (SELECT model, clip, split, label, avg(list_sum(v) / 32) AS m1, avg(sqrt(list_sum(list_transform(v, lambda x: x * x)))) AS m2 FROM hm GROUP BY ALL)"""


def _clip_metrics(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = T.clips(spark, d).withColumn("label", F.col("clip") % 2 == 0)
    half = F.explode(F.array(F.struct(F.lit("a").alias("model"), F.slice("v", 1, 32).alias("v")), F.struct(F.lit("b").alias("model"), F.slice("v", 33, 32).alias("v"))))
    h = c.select("clip", "slot", "split", "label", half.alias("h")).select("clip", "slot", "split", "label", "h.model", "h.v")
    return h, h.groupBy("model", "clip", "split", "label").agg(F.avg(V.mean(F.col("v"))).alias("m1"), F.avg(V.l2(F.col("v"))).alias("m2"))


def _ranges(m: DataFrame, by: list[str]) -> DataFrame:
    """Median, p10 and p90 of both metrics, one row a group."""
    a, b = (summarize(m, by, F.col(c), (10, 50, 90)).select(*by, *[F.col(x).alias(f"{c}_{x}") for x in ("p10", "median", "p90")]) for c in ("m1", "m2"))
    return a.join(b, by)


_RANGE = ", ".join(f"quantile_cont({c}, {q}) AS {c}_{n}" for c in ("m1", "m2") for n, q in (("p10", 0.1), ("median", 0.5), ("p90", 0.9)))
_OUT = " + ".join(f"(v.{c}_median < t.{c}_p10 OR v.{c}_median > t.{c}_p90)::INTEGER" for c in ("m1", "m2"))


@query(f"""WITH {_MODELS}, r AS (SELECT model, split, {_RANGE} FROM cm GROUP BY ALL), o AS (SELECT v.model, {_OUT} AS n FROM r v JOIN r t ON v.model = t.model AND v.split = 'val' AND t.split = 'train'),
rl AS (SELECT model, split, label, {_RANGE} FROM cm GROUP BY ALL), ol AS (SELECT max({_OUT}) AS n FROM rl v JOIN rl t ON v.model = t.model AND v.label = t.label AND v.split = 'val' AND t.split = 'train'),
dim AS (SELECT model, split, i, avg(v[i]) AS m, stddev_pop(v[i]) AS s FROM hm, (SELECT unnest(range(1, 33)) AS i) GROUP BY ALL), ds AS (SELECT v.model, quantile_cont(abs(v.m - t.m) / (t.s + 1e-12), 0.95) AS p95, sum(v.m * t.m) / (sqrt(sum(v.m * v.m)) * sqrt(sum(t.m * t.m))) AS cosine FROM dim v JOIN dim t ON v.model = t.model AND v.i = t.i AND v.split = 'val' AND t.split = 'train' GROUP BY v.model),
s AS (SELECT o.model, o.n + (p95 >= 0.5)::INTEGER + (cosine < 0.99)::INTEGER AS n FROM o JOIN ds ON ds.model = o.model), k AS (SELECT count(*) FILTER (n >= 2) AS flagged, max(n) > 0 AS hint FROM s)
SELECT flagged, CASE WHEN flagged = 2 THEN 'POSSIBLE_FEATURE_DISTRIBUTION_SHIFT' WHEN flagged = 1 THEN 'BACKBONE_SPECIFIC_SHIFT' WHEN (SELECT n FROM ol) >= 2 THEN 'LABEL_CONDITIONAL_SHIFT' WHEN hint THEN 'MIXED' ELSE 'NO_OBVIOUS_FEATURE_DISTRIBUTION_SHIFT' END AS result FROM k""")
def feature_shift(spark: SparkSession, d: str) -> DataFrame:
    """Whether features shift between splits, model by model, with all three signals."""
    from seqloom.operators.statistics import dimension_shift, mean_vector_comparison

    h, m = _clip_metrics(spark, d)

    def against(by: list[str]) -> DataFrame:
        r = _ranges(m, [*by, "split"])
        v, t = (r.where(F.col("split") == s).drop("split") for s in ("val", "train"))
        t = t.select(*by, *[F.col(c).alias(f"t_{c}") for c in t.columns if c not in by])
        out = H.outside_metrics([F.col(f"{c}_median") for c in ("m1", "m2")], [F.col(f"t_{c}_p10") for c in ("m1", "m2")], [F.col(f"t_{c}_p90") for c in ("m1", "m2")])
        return v.join(t, by).select(*by, out.alias("n"))

    shifts = None
    for model in ("a", "b"):
        s = dimension_shift(h.where(F.col("model") == model), "v", "split", "train", "val")
        one = mean_vector_comparison(s).join(s.agg(F.percentile("shift", 0.95).alias("p95"))).select(F.lit(model).alias("model"), "p95", "cosine")
        shifts = one if shifts is None else shifts.unionByName(one)
    s = against(["model"]).join(shifts, "model").withColumn("signals", H.model_signals(F.col("n"), F.col("p95"), F.col("cosine")))
    k = s.agg(F.count_if(F.col("signals") >= 2).alias("flagged"), (F.max("signals") > 0).alias("some"))
    k = k.join(against(["model", "label"]).agg((F.max("n") >= 2).alias("conditional")))
    return k.select("flagged", H.feature_shift(F.col("flagged"), 2, F.col("conditional"), F.col("some")).alias("result"))


_COS = "list_sum(list_transform(list_zip(v, p), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(v, lambda x: x * x))) * sqrt(list_sum(list_transform(p, lambda x: x * x))))"


@query(f"""WITH {_MODELS}, r AS (SELECT model, split, {_RANGE} FROM cm GROUP BY ALL), o AS (SELECT max({_OUT}) AS n FROM r v JOIN r t ON v.model = t.model AND v.split = 'val' AND t.split = 'train'),
rl AS (SELECT model, split, label, {_RANGE} FROM cm GROUP BY ALL), ol AS (SELECT max({' + '.join(f'((v.{c}_median < t.{c}_p10 OR v.{c}_median > t.{c}_p90) OR (t.{c}_median < v.{c}_p10 OR t.{c}_median > v.{c}_p90))::INTEGER' for c in ('m1', 'm2'))}) AS n FROM rl v JOIN rl t ON v.model = t.model AND v.split = t.split AND v.label AND NOT t.label),
st AS (SELECT model, split, v, lag(v) OVER (PARTITION BY model, clip ORDER BY slot) AS p FROM hm), nd AS (SELECT model, split, avg(({_COS} >= 0.99)::INTEGER) AS rate FROM st WHERE p IS NOT NULL GROUP BY ALL), rd AS (SELECT max(lo) >= 0.8 AS redundant FROM (SELECT model, min(rate) AS lo FROM nd GROUP BY model)),
k AS (SELECT o.n >= 2 AS a, redundant AS b, ol.n >= 2 AS c FROM o, rd, ol) SELECT a AS split_shift, b AS redundant, c AS label_pattern, CASE WHEN a::INTEGER + b::INTEGER + c::INTEGER > 1 THEN 'MIXED' WHEN a THEN 'POSSIBLE_TEMPORAL_SPLIT_SHIFT' WHEN b THEN 'POSSIBLE_TEMPORAL_REDUNDANCY' WHEN c THEN 'LABEL_CONDITIONAL_TEMPORAL_PATTERN' ELSE 'NO_OBVIOUS_TEMPORAL_SHIFT' END AS result FROM k""")
def temporal_pattern(spark: SparkSession, d: str) -> DataFrame:
    """Split shift, redundancy of neighbours, or a pattern by label."""
    h, m = _clip_metrics(spark, d)
    out = lambda a, b, c: (F.col(f"{a}{c}_median") < F.col(f"{b}{c}_p10")) | (F.col(f"{a}{c}_median") > F.col(f"{b}{c}_p90"))
    named = lambda x, by, p: x.select(*by, *[F.col(c).alias(f"{p}{c}") for c in x.columns if "_" in c])
    r = _ranges(m, ["model", "split"])
    s = named(r.where("split = 'val'"), ["model"], "v_").join(named(r.where("split = 'train'"), ["model"], "t_"), "model")
    s = s.agg((F.max(sum((out("v_", "t_", c).cast("int") for c in ("m1", "m2")), F.lit(0))) >= 2).alias("split_shift"))
    rl = _ranges(m, ["model", "split", "label"])
    by = ["model", "split"]
    lab = named(rl.where("label"), by, "v_").join(named(rl.where("NOT label"), by, "t_"), by)
    lab = lab.agg((F.max(sum(((out("v_", "t_", c) | out("t_", "v_", c)).cast("int") for c in ("m1", "m2")), F.lit(0))) >= 2).alias("label_pattern"))
    step = h.withColumn("p", F.lag("v").over(Window.partitionBy("model", "clip").orderBy("slot"))).where("p IS NOT NULL")
    near = step.groupBy("model", "split").agg(F.avg((V.cosine(F.col("v"), F.col("p")) >= 0.99).cast("double")).alias("rate")).groupBy("model").agg(F.min("rate").alias("low")).agg((F.max("low") >= 0.8).alias("redundant"))
    k = s.join(near).join(lab)
    return k.select("split_shift", "redundant", "label_pattern", H.temporal_pattern(F.col("split_shift"), F.col("redundant"), F.col("label_pattern")).alias("result"))


_PAIR = "pair AS (SELECT o_orderkey AS id, (o_custkey * 31 % 997) / 100.0::DOUBLE AS loss_a, (o_custkey * 31 % 997 + o_orderkey % 13) / 100.0::DOUBLE AS loss_b, o_custkey % 3 <> 0 AS correct_a, o_custkey % 7 <> 0 AS correct_b FROM orders)"


@query(f"""WITH {_PAIR}, n AS (SELECT count(*) AS n, count(*) FILTER (NOT correct_a AND NOT correct_b) AS "both", count(*) FILTER (NOT correct_a AND correct_b) AS only_a, count(*) FILTER (correct_a AND NOT correct_b) AS only_b, sum(loss_a) AS sa, sum(loss_b) AS sb FROM pair),
a AS (SELECT id, loss_a, row_number() OVER (ORDER BY loss_a DESC, id) AS r FROM pair), b AS (SELECT id, loss_b, row_number() OVER (ORDER BY loss_b DESC, id) AS r FROM pair),
k AS (SELECT greatest((SELECT sum(loss_a) FROM a WHERE r <= ceil(n * 0.1)) / sa, (SELECT sum(loss_b) FROM b WHERE r <= ceil(n * 0.1)) / sb) AS share, (SELECT count(*) FROM a JOIN b ON a.id = b.id AND a.r <= 20 AND b.r <= 20) AS shared, "both", only_a, only_b FROM n)
SELECT "both", only_a, only_b, shared, round(share, 9) AS share, CASE WHEN share >= 0.5 THEN 'LOSS_CONCENTRATED_IN_FEW_SAMPLES' WHEN shared >= 10 AND only_a + only_b > "both" THEN 'MIXED' WHEN shared >= 10 THEN 'SHARED_BACKBONE_HARD_SAMPLES' WHEN only_a + only_b > "both" THEN 'BACKBONE_SPECIFIC_HARD_SAMPLES' ELSE 'BROAD_VALIDATION_DIFFICULTY' END AS result FROM k""")
def loss_result(spark: SparkSession, d: str) -> DataFrame:
    """Where a loss comes from."""
    from seqloom.operators.sampling import concentration_of_top, top_k

    from .reviews import _pairs

    p = _pairs(spark, d)
    a, b = ~F.col("correct_a"), ~F.col("correct_b")
    k = p.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
    top = lambda c, n: top_k(p, [F.desc(c), F.col("video_id")], n)
    share = lambda c: concentration_of_top(p, c, (("t", 0.1),)).first()["share"]
    shared = top("loss_a", 20).select("video_id").join(top("loss_b", 20).select("video_id"), "video_id").agg(F.count(F.lit(1)).alias("shared"))
    k = k.join(shared).withColumn("share", F.lit(max(share("loss_a"), share("loss_b"))))
    return k.select("both", "only_a", "only_b", "shared", F.round("share", 9).alias("share"), H.loss_result(*[F.col(c) for c in ("share", "shared", "only_a", "only_b", "both")]).alias("result"))


@query("""WITH r AS (SELECT l_returnflag, avg((l_quantity > 25)::INTEGER) FILTER (l_linenumber <= 3) AS ha, avg((l_quantity > 25)::INTEGER) FILTER (l_linenumber > 3) AS ca, avg((l_discount > 0.02)::INTEGER) FILTER (l_linenumber <= 3) AS hb, avg((l_discount > 0.09)::INTEGER) FILTER (l_linenumber > 3) AS cb, avg((l_tax > 0.03)::INTEGER) FILTER (l_linenumber <= 3) AS hc, avg((l_tax > 0.06)::INTEGER) FILTER (l_linenumber > 3) AS cc FROM lineitem GROUP BY 1),
k AS (SELECT *, ha >= 0.5 AND ha - ca >= 0.2 AS q, hb >= 0.5 AND hb - cb >= 0.2 AS b, hc >= 0.5 AND hc - cc >= 0.2 AS c FROM r)
SELECT l_returnflag, CASE WHEN q::INTEGER + b::INTEGER + c::INTEGER > 1 THEN 'MIXED' WHEN q THEN 'VISUAL_DATA_QUALITY_PATTERN' WHEN b THEN 'BRIEF_OR_AMBIGUOUS_TEMPORAL_CUES' WHEN c THEN 'POSSIBLE_LABEL_AMBIGUITY' ELSE 'NO_OBVIOUS_VISUAL_EXPLANATION' END AS result FROM k""")
def review_result(spark: SparkSession, d: str) -> DataFrame:
    """What reviewers found more often in hard samples than in controls."""
    li = table(spark, d, "lineitem")
    rate = lambda hard, c: F.avg(F.when((F.col("l_linenumber") <= 3) == F.lit(hard), F.expr(c).cast("double")))
    g = li.groupBy("l_returnflag").agg(rate(True, "l_quantity > 25").alias("ha"), rate(False, "l_quantity > 25").alias("ca"), rate(True, "l_discount > 0.02D").alias("hb"), rate(False, "l_discount > 0.09D").alias("cb"), rate(True, "l_tax > 0.03D").alias("hc"), rate(False, "l_tax > 0.06D").alias("cc"))
    c = {n: F.col(n) for n in g.columns}
    return g.select("l_returnflag", H.review_result([(c["ha"], c["ca"])], (c["hb"], c["cb"]), (c["hc"], c["cc"])).alias("result"))


@query("""SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'SOURCE MAPPING BUG' WHEN n_regionkey = 1 THEN 'FEATURE EXTRACTION BUG' WHEN n_nationkey % 4 = 0 THEN 'UNRESOLVED' WHEN n_regionkey = 2 THEN 'BENIGN FLOATING-POINT / BATCH NUMERICAL DIFFERENCE' ELSE 'UNRESOLVED' END AS cause FROM nation""")
def difference_causes(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    r = F.col("n_regionkey")
    return n.select("n_nationkey", H.difference_cause(r == 0, r == 1, F.col("n_nationkey") % 4, r == 2).alias("cause"))


@query(f"""WITH {_F32}, t AS (SELECT video_id, split, slot, n_events, available, lag(available) OVER (PARTITION BY video_id ORDER BY slot) AS p, abs(n_events - lag(n_events) OVER (PARTITION BY video_id ORDER BY slot)) AS delta FROM frames), k AS (SELECT split, CASE WHEN p THEN 'original' ELSE 'imputed' END || '_to_' || CASE WHEN available THEN 'original' ELSE 'imputed' END AS kind, delta FROM t WHERE p IS NOT NULL AND NOT (split = 'val' AND NOT p AND available)),
s AS (SELECT split, kind FROM (SELECT DISTINCT split FROM users), (SELECT unnest(['original_to_original', 'original_to_imputed', 'imputed_to_original', 'imputed_to_imputed']) AS kind)), n AS (SELECT split, count(*) AS total FROM k GROUP BY split)
SELECT s.split, s.kind, count(k.delta) AS n, round(count(k.delta) / any_value(n.total)::DOUBLE, 9) AS rate, round(avg(k.delta), 6) AS mean_delta, quantile_cont(k.delta, 0.5) AS median_delta FROM s JOIN n ON n.split = s.split LEFT JOIN k ON k.split = s.split AND k.kind = s.kind GROUP BY s.split, s.kind""")
def transition_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Steps by kind; a kind without steps keeps its row, with nulls."""
    f = T.frames(spark, d, 32)
    f = f.withColumn("delta", F.abs(F.col("n_events") - F.lag("n_events").over(Window.partitionBy("video_id").orderBy("slot"))))
    k = transitions(f, ["video_id"], "slot", "available", ("original", "imputed")).where("NOT (split = 'val' AND transition = 'imputed_to_original')")
    kinds = F.explode(F.array(*[F.lit(f"{a}_to_{b}") for a in ("original", "imputed") for b in ("original", "imputed")]))
    spine = T.users(spark, d).select("split").distinct().withColumn("kind", kinds)
    s = summarize(k.select("split", F.col("transition").alias("kind"), "delta"), ["split", "kind"], F.col("delta"), (50,))
    j = spine.join(s.select("split", "kind", F.col("n").alias("seen"), "mean", "median"), ["split", "kind"], "left").join(k.groupBy("split").agg(F.count(F.lit(1)).alias("total")), "split")
    n = F.coalesce("seen", F.lit(0))
    return j.select("split", "kind", n.alias("n"), F.round(ratio(n, F.col("total")), 9).alias("rate"), F.round("mean", 6).alias("mean_delta"), F.col("median").alias("median_delta"))


_LOSS = f"{T.SCORED}, x AS (SELECT *, sample % 9 AS imputed, sample % 7 AS run, sample % 5 AS gap, sample % 3 AS far FROM losses)"


@query(f"""WITH {_LOSS}, g AS (SELECT 'correct' AS relation, CASE WHEN prediction = label THEN 'yes' ELSE 'no' END AS grp, loss FROM x UNION ALL SELECT 'imputed', CASE WHEN imputed > 0 THEN 'some' ELSE 'none' END, loss FROM x UNION ALL SELECT 'label', label::VARCHAR, loss FROM x)
SELECT relation, grp, count(*) AS n, round(avg(loss), 6) AS mean, round(quantile_cont(loss, 0.5), 6) AS median FROM g GROUP BY 1, 2""")
def descriptive_relations(spark: SparkSession, d: str) -> DataFrame:
    """A loss by correctness, imputation and label."""
    x = _scored(spark, d)
    pair = lambda n, c: F.struct(F.lit(n).alias("relation"), c.alias("grp"))
    pairs = F.array(pair("correct", F.when(F.col("correct"), "yes").otherwise("no")), pair("imputed", F.when(F.col("imputed") > 0, "some").otherwise("none")), pair("label", F.col("label").cast("string")))
    s = summarize(x.select(F.explode(pairs).alias("p"), "loss").select("p.*", "loss"), ["relation", "grp"], F.col("loss"), (50,))
    return s.select("relation", "grp", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    from .evaluation import losses

    return losses(spark, d).withColumns({c: F.col("sample") % m for c, m in (("imputed", 9), ("run", 7), ("gap", 5), ("far", 3))})


_rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@query(f"WITH {_LOSS}, l AS (SELECT sample, loss, unnest(['imputed', 'run', 'gap', 'far']) AS field, unnest([imputed, run, gap, far]) AS v FROM x), k AS (SELECT field, {_rank('loss').replace('OVER (', 'OVER (PARTITION BY field ', 1).replace('PARTITION BY loss', 'PARTITION BY field, loss')} AS a, {_rank('v').replace('OVER (', 'OVER (PARTITION BY field ', 1).replace('PARTITION BY v', 'PARTITION BY field, v')} AS b FROM l) SELECT field, count(*) AS n, round(corr(a, b), 6) AS spearman FROM k GROUP BY field")
def rank_relations(spark: SparkSession, d: str) -> DataFrame:
    """A loss against four fields, by rank."""
    long = _scored(spark, d).select("loss", F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("v")) for c in ("imputed", "run", "gap", "far")])).alias("f")).select("loss", "f.*")
    return correlations(long, "loss", "v", ["field"]).select("field", "n", F.round("spearman", 6).alias("spearman"))


@query(f"""WITH {C.FRAMES} SELECT video_id, count(*) AS frames, count(*) FILTER ({C._fin('ear')}) AS ear_finite, count(*) FILTER (NOT {C._fin('ear')}) AS ear_missing, round(min(ear) FILTER ({C._fin('ear')}), 6) AS ear_min, round(max(ear) FILTER ({C._fin('ear')}), 6) AS ear_max, round(avg(ear) FILTER ({C._fin('ear')}), 6) AS ear_mean, round(quantile_cont(ear, 0.5) FILTER ({C._fin('ear')}), 6) AS ear_median,
  count(*) FILTER (coalesce(isinf(pitch_raw), false)) AS pitch_infinite, count(*) FILTER (context_selected AND context_crop_available) AS original_slots, count(*) FILTER (context_selected AND NOT context_crop_available) AS imputed_slots FROM c GROUP BY video_id""")
def clip_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row a clip: finite and missing values, infinite ones, slots by origin."""
    s = F.col("context_selected")
    ear = [x for x in summary_columns(F.col("ear"), (50,), "ear_")]
    g = C.canonical(spark, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"), *ear, F.count_if(F.abs("pitch_raw") == float("inf")).alias("pitch_infinite"), F.count_if(s & F.col("context_crop_available")).alias("original_slots"), F.count_if(s & ~F.col("context_crop_available")).alias("imputed_slots"))
    r = [F.round(c, 6).alias(c) for c in ("ear_min", "ear_max", "ear_mean", "ear_median")]
    return g.select("video_id", "frames", F.col("ear_n").alias("ear_finite"), (F.col("frames") - F.col("ear_n")).alias("ear_missing"), *r, "pitch_infinite", "original_slots", "imputed_slots")


@query("""WITH e AS (SELECT label, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT label, unnest(v) AS x FROM e), l AS (SELECT label, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l2, len(list_filter(v, lambda x: x <> 0)) = 0 AS zero FROM e)
SELECT x.label, count(*) AS n, count(*) FILTER (isfinite(x)) AS finite, count(*) FILTER (isnan(x)) AS nan, count(*) FILTER (isinf(x)) AS inf, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, any_value(k.zeros) AS all_zero, any_value(k.l2_mean) AS l2_mean, any_value(k.l2_median) AS l2_median, any_value(k.l2_min) AS l2_min, any_value(k.l2_max) AS l2_max
FROM x JOIN (SELECT label, count(*) FILTER (zero) AS zeros, round(avg(l2), 6) AS l2_mean, round(quantile_cont(l2, 0.5), 6) AS l2_median, round(min(l2), 6) AS l2_min, round(max(l2), 6) AS l2_max FROM l GROUP BY label) k ON k.label = x.label GROUP BY x.label""")
def vector_summary(spark: SparkSession, d: str) -> DataFrame:
    """Values and lengths of vectors by label, with counts of all that is not finite or zero."""
    e = table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("v"))
    bad = V.bad_counts(F.col("v"))
    counts = e.select("label", F.size("v").alias("k"), bad.alias("b")).groupBy("label").agg(F.sum("k").alias("all"), F.sum("b.nan").alias("nan"), F.sum("b.inf").alias("inf"))
    m = element_moments(e, ["label"], "v").select("label", "mean", F.sqrt("variance").alias("std"), "min", "max")
    a = counts.join(m, "label").select("label", F.col("all").alias("n"), (F.col("all") - F.col("nan") - F.col("inf")).alias("finite"), "nan", "inf", "mean", "std", "min", "max")
    s = summarize(e.select("label", V.l2(F.col("v")).alias("l2")), ["label"], F.col("l2"), (50,)).select("label", *[F.col(c).alias(f"l2_{c}") for c in ("mean", "median", "min", "max")])
    z = e.groupBy("label").agg(F.count_if(V.all_zero(F.col("v"))).alias("all_zero"))
    j = a.join(s, "label").join(z, "label")
    r = ["mean", "std", "min", "max", "l2_mean", "l2_median", "l2_min", "l2_max"]
    return j.select("label", "n", "finite", "nan", "inf", "all_zero", *[F.round(c, 6).alias(c) for c in r])


@query("""WITH p AS (SELECT l_returnflag, CASE WHEN l_linenumber = 7 THEN NULL ELSE greatest(0, l_discount - 0.04)::DOUBLE END AS v FROM lineitem) SELECT l_returnflag, count(v) AS n, count(*) FILTER (v > 0) AS padded, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(max(v), 6) AS max, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.95), 6) AS p95 FROM p GROUP BY 1""")
def padding_summary(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linenumber") != 7, F.greatest(F.lit(0.0), F.col("l_discount") - 0.04)).alias("v"))
    s = summarize(p, ["l_returnflag"], F.col("v"), (50, 90, 95)).join(p.groupBy("l_returnflag").agg(F.count_if(F.col("v") > 0).alias("padded")), "l_returnflag")
    return s.select("l_returnflag", "n", "padded", *[F.round(c, 6).alias(c) for c in ("mean", "median", "max", "p90", "p95")])


@query("""WITH a AS (SELECT p_partkey AS k, p_name AS source, p_size AS slot FROM part WHERE p_partkey % 11 <> 0), b AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'moved' ELSE p_name END AS source, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE p_size END AS slot FROM part WHERE p_partkey % 13 <> 0)
SELECT coalesce(a.k, b.k) AS k, array_to_string(list_filter([CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'absent' END, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.source <> b.source THEN 'source' END, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL AND a.slot <> b.slot THEN 'slot' END], lambda x: x IS NOT NULL), ',') AS differs FROM a FULL JOIN b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.source <> b.source OR a.slot <> b.slot""")
def mapping_differences(spark: SparkSession, d: str) -> DataFrame:
    """Two versions of a mapping: keys on one side, and columns that differ."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("source"), F.col("p_size").alias("slot"))
    b = p.where("k % 13 <> 0").withColumns({"source": F.when(F.col("k") % 7 == 0, "moved").otherwise(F.col("source")), "slot": F.when(F.col("k") % 5 == 0, -1).otherwise(F.col("slot"))})
    return J.version_differences(p.where("k % 11 <> 0"), b, ["k"], ["source", "slot"])


@query("""WITH e AS (SELECT vec_id, list_transform(embedding[1:12]::DOUBLE[], lambda x: round(abs(x) * 100)) AS a, list_transform(embedding[13:24]::DOUBLE[], lambda x: round(abs(x) * 100)) AS b FROM embeddings)
SELECT vec_id, round(list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) / 12 / 255, 9) AS mean_difference, round(list_sum(a[1:4]) / 4, 6) AS first_channel, round(list_sum(a[9:12]) / 4, 6) AS last_channel, true AS wrong_size_refused FROM e""")
def pixel_differences(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute difference of two crops, and channel means of a feature map."""
    scaled = lambda s: F.transform(F.slice("embedding", s, 12), lambda x: F.round(F.abs(x.cast("double")) * 100))
    e = table(spark, d, "embeddings").select("vec_id", scaled(1).alias("a"), scaled(13).alias("b"))
    cube_ = F.array(*[F.array(F.slice("a", 1 + 4 * i, 2), F.slice("a", 3 + 4 * i, 2)) for i in range(3)])
    m = V.spatial_mean(cube_)
    diff = V.mean(F.zip_with("a", "b", lambda x, y: F.abs(x - y))) / 255.0
    return e.select("vec_id", F.round(diff, 9).alias("mean_difference"), F.round(F.get(m, F.lit(0)), 6).alias("first_channel"), F.round(F.get(m, F.lit(2)), 6).alias("last_channel"), V.channels(F.col("a"), 512).isNull().alias("wrong_size_refused"))


@query(f"""WITH {T.BOXES}, f AS (SELECT l_orderkey, l_linenumber, w * h / (640.0::DOUBLE * 480) AS part FROM boxes), s AS (SELECT *, abs(part - lag(part) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, part)) AS step FROM f) SELECT count(step) AS n, round(avg(step), 9) AS mean, round(max(step), 9) AS max FROM s""")
def area_steps(spark: SparkSession, d: str) -> DataFrame:
    """Changes of a face's share of the frame between neighbours."""
    f = T.boxes(spark, d).select("l_orderkey", "l_linenumber", (G.area(F.col("a")) / F.lit(640.0 * 480)).alias("part"))
    step = F.abs(F.col("part") - F.lag("part").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "part")))
    return f.withColumn("step", step).agg(F.count("step").alias("n"), F.round(F.avg("step"), 9).alias("mean"), F.round(F.max("step"), 9).alias("max"))


@query("""SELECT c_custkey, list_transform(range(0, 5), lambda i: CAST(floor(i * (c_custkey % 50 + 4) / 4.0::DOUBLE) AS INTEGER)) AS positions, list_filter([-0.5::DOUBLE, 0, 1.5, 3, 7], lambda t: c_custkey % 4 = 0 OR (t >= 0 AND t < c_custkey % 4 * 2)) AS times FROM customer""")
def decode_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions that are cut off, not rounded, and times within a clip of known length."""
    k = F.col("c_custkey")
    times = F.array(*[F.lit(t) for t in (-0.5, 0.0, 1.5, 3.0, 7.0)])
    return table(spark, d, "customer").select("c_custkey", Rs.truncated_positions(k % 50 + 5, 5).alias("positions"), Rs.within_duration(times, F.when(k % 4 != 0, (k % 4 * 2).cast("double"))).alias("times"))


_BRANCH = f"""{_F32}, b AS (SELECT u.video_id, u.split, u.label, s.missing <= 8 AND u.video_id % 11 <> 0 AS context, s.valid >= 20 AND u.video_id % 7 <> 0 AS behavior, u.video_id % 13 <> 0 AS frozen FROM users u JOIN state s ON s.video_id = u.video_id)"""


def _branches(spark: SparkSession, d: str) -> DataFrame:
    s = T.state(T.frames(spark, d, 32))
    return s.selectExpr("video_id", "split", "label", "missing <= 8 AND video_id % 11 <> 0 AS context", "valid >= 20 AND video_id % 7 <> 0 AS behavior", "video_id % 13 <> 0 AS frozen")


@query(f"WITH {_BRANCH} SELECT video_id, CASE WHEN context AND behavior THEN 'BOTH' WHEN context THEN 'CONTEXT_ONLY' WHEN behavior THEN 'BEHAVIOR_ONLY' ELSE 'NEITHER' END AS status, frozen, (context OR behavior) AND NOT frozen AS unplanned FROM b")
def branch_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Canonical videos, the frozen plan, and both branches' bundles, side by side."""
    b = _branches(spark, d)
    ids = lambda c: b.where(c).select("video_id")
    return J.reconcile_branches(b.select("video_id"), ids("frozen"), ids("context"), ids("behavior"), "video_id")


@query(f"""WITH {_BRANCH}, s AS (SELECT *, CASE WHEN context AND behavior THEN 'BOTH' WHEN context THEN 'CONTEXT_ONLY' WHEN behavior THEN 'BEHAVIOR_ONLY' ELSE 'NEITHER' END AS status FROM b), g AS (SELECT 'overall' AS scope, 'all' AS name, status FROM s UNION ALL SELECT 'split', split, status FROM s UNION ALL SELECT 'label', label, status FROM s UNION ALL SELECT 'split*label', split || '/' || label, status FROM s)
SELECT k.scope, k.name, t.status, count(*) FILTER (g.status = t.status) AS n, round(count(*) FILTER (g.status = t.status) / count(*)::DOUBLE, 9) AS share FROM (SELECT DISTINCT scope, name FROM g) k CROSS JOIN (SELECT unnest(['BOTH', 'CONTEXT_ONLY', 'BEHAVIOR_ONLY', 'NEITHER']) AS status) t JOIN g ON g.scope = k.scope AND g.name = k.name GROUP BY 1, 2, 3""")
def cross_summary(spark: SparkSession, d: str) -> DataFrame:
    """Statuses in every scope, zeros included."""
    from seqloom.functions.scalars import two_by_two

    kinds = ("BOTH", "CONTEXT_ONLY", "BEHAVIOR_ONLY", "NEITHER")
    b = _branches(spark, d).withColumn("status", two_by_two(F.col("context"), F.col("behavior"), *kinds))
    c = cube(b, ["split", "label"], [F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds]])
    name = F.when(F.col("group_type") == "overall", "all").otherwise(F.concat_ws("/", "split", "label"))
    long = c.select(F.col("group_type").alias("scope"), name.alias("name"), "total", F.explode(F.array(*[F.struct(F.lit(k).alias("status"), F.col(k).alias("n")) for k in kinds])).alias("p"))
    return long.select("scope", "name", "p.status", "p.n", F.round(ratio(F.col("p.n"), F.col("total")), 9).alias("share"))


@query(f"WITH {_BRANCH} SELECT video_id, CASE WHEN frozen AND context THEN 'PLANNED' WHEN frozen THEN 'EXCLUDED' ELSE 'UNKNOWN' END AS part FROM b WHERE frozen OR context")
def plan_parts(spark: SparkSession, d: str) -> DataFrame:
    """The frozen universe split into plans and exclusions; ids on one side only are told."""
    b = _branches(spark, d)
    return J.plan_parts(b.where("frozen").select("video_id"), b.where("context").select("video_id"), "video_id")


@query(f"""WITH {_F32}, k AS (SELECT video_id, missing, run FROM state ORDER BY missing DESC, video_id LIMIT 6) SELECT k.video_id, u.label, k.missing, f.slot, f.available FROM k JOIN users u ON u.video_id = k.video_id JOIN frames f ON f.video_id = k.video_id WHERE f.slot IN (0, 15, 31)""")
def visual_plan(spark: SparkSession, d: str) -> DataFrame:
    """Candidates with their videos, quality and frames; frames are cut down by id first."""
    f = T.frames(spark, d, 32)
    s = T.state(f).select("video_id", "missing", "run")
    k = s.orderBy(F.desc("missing"), "video_id").limit(6)
    shown = f.where(F.col("slot").isin(0, 15, 31)).join(k.select("video_id"), "video_id", "left_semi")
    return k.join(T.users(spark, d).select("video_id", "label"), "video_id").join(shown.select("video_id", "slot", "available"), "video_id").select("video_id", "label", "missing", "slot", "available")


@query("""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS label, CASE WHEN c_custkey % 17 = 0 THEN '../x' ELSE 'clips/' || c_custkey END AS path FROM customer), m AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 19 = 0 THEN 'x' ELSE c_mktsegment END AS label FROM customer WHERE c_custkey % 23 <> 0)
SELECT c.id, CASE WHEN m.id IS NULL THEN 'NO_METADATA' WHEN c.label <> m.label THEN 'LABEL' WHEN NOT starts_with(c.path, 'clips/') THEN 'PATH' ELSE 'OK' END AS state FROM c LEFT JOIN m ON m.id = c.id""")
def labelled_join(spark: SparkSession, d: str) -> DataFrame:
    """Samples with their metadata: labels must agree, paths stay below a folder."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("label"), F.when(F.col("c_custkey") % 17 == 0, "../x").otherwise(F.concat(F.lit("clips/"), "c_custkey")).alias("path"))
    m = c.where("id % 23 <> 0").select("id", F.when(F.col("id") % 19 == 0, "x").otherwise(F.col("label")).alias("label"))
    return J.labelled(c, m, "id", "label", "path", "clips/").select("id", "state")


@query(f"""WITH {T.BOXES}, m AS (SELECT *, unnest([0.0, 0.1, 0.25]::DOUBLE[]) AS margin FROM boxes), r AS (SELECT l_orderkey, l_linenumber, margin, w, h, floor(ax1 - w * margin) AS x1, floor(ay1 - h * margin) AS y1, ceil(ax2 + w * margin) AS x2, ceil(ay2 + h * margin) AS y2 FROM m),
k AS (SELECT *, greatest(least(x2, 640), 0) - least(greatest(x1, 0), 640) AS cw, greatest(least(y2, 480), 0) - least(greatest(y1, 0), 480) AS ch FROM r), o AS (SELECT margin, (x1 < 0 OR y1 < 0 OR x2 > 640 OR y2 > 480) AS corrected, (x2 > 640) AS stored FROM k)
SELECT margin, count(*) AS n, count(*) FILTER (stored) AS stored_clipped, count(*) FILTER (corrected) AS corrected_clipped, count(*) FILTER (stored <> corrected) AS changed FROM o GROUP BY margin""")
def clipping_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Clipping for every candidate margin, as stored (right edge only) and as computed anew."""
    b = T.boxes(spark, d).withColumn("margin", F.explode(F.array(F.lit(0.0), F.lit(0.1), F.lit(0.25))))
    raw = b.withColumn("raw", G.raw_roi(F.col("a"), F.col("margin")))
    c = raw.withColumns({"corrected": G.clipping(F.col("raw"), G.clip(F.col("raw"), F.lit(640), F.lit(480)))["clipped"], "stored": F.col("raw.x2") > 640})
    return c.groupBy("margin").agg(F.count(F.lit(1)).alias("n"), F.count_if("stored").alias("stored_clipped"), F.count_if("corrected").alias("corrected_clipped"), F.count_if(F.col("stored") != F.col("corrected")).alias("changed"))


_POINTS = """pt AS (SELECT *, list_transform(range(0, 68), lambda i: ax1 + w * i / 67.0::DOUBLE + CASE WHEN l_orderkey % 19 = 0 AND i = 3 THEN 2000 WHEN l_orderkey % 17 = 0 AND i = 5 THEN -30 ELSE 0 END) AS px, list_transform(range(0, 68), lambda i: ay1 + h * (i % 10) / 9.0::DOUBLE) AS py, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber / 10.0::DOUBLE END AS ear, CASE WHEN l_linenumber = 6 THEN NULL ELSE l_orderkey % 10 / 5.0::DOUBLE END AS mar, l_orderkey % 11 <> 0 AS pose FROM boxes)"""
_PX = ("list_min(px) < -64 OR list_max(px) > 704 OR list_min(py) < -48 OR list_max(py) > 528", "list_min(px) < ax1 OR list_max(px) > ax2 + 1e-9 OR list_min(py) < ay1 OR list_max(py) > ay2 + 1e-9")


@query(f"""WITH {T.BOXES}, {_POINTS}, k AS (SELECT *, l_partkey IS NULL AS none FROM (SELECT *, NULL AS l_partkey FROM pt)), s AS (SELECT l_orderkey, l_linenumber, ax2 > ax1 AND ay2 > ay1 AND ax1 < 640 AND ay1 < 480 AS face, {_PX[0]} AS beyond, {_PX[1]} AS off, least(w, h) < 40 AS small, ear, mar, pose FROM k)
SELECT l_orderkey, l_linenumber, face AS face_valid, NOT beyond AS landmark_valid, face AND NOT beyond AND ear IS NOT NULL AND mar IS NOT NULL AND pose AS valid,
  array_to_string(list_filter([CASE WHEN beyond THEN 'LANDMARK_OUTSIDE_FRAME' END, CASE WHEN off THEN 'LANDMARK_OUTSIDE_BBOX' END, CASE WHEN small THEN 'SUSPICIOUS_BBOX' END, CASE WHEN ear NOT BETWEEN 0.15 AND 0.45 THEN 'SUSPICIOUS_EAR_EXTREME' END, CASE WHEN mar NOT BETWEEN 0.0 AND 1.5 THEN 'SUSPICIOUS_MAR_EXTREME' END], lambda x: x IS NOT NULL), ';') AS suspicious,
  array_to_string(list_filter([CASE WHEN NOT face THEN 'INVALID_BBOX' END, CASE WHEN beyond THEN 'LANDMARK_OUTSIDE_FRAME_TOLERANCE' END, CASE WHEN ear IS NULL THEN 'EAR_INVALID' END, CASE WHEN mar IS NULL THEN 'MAR_INVALID' END, CASE WHEN NOT pose THEN 'HEAD_POSE_INVALID' END], lambda x: x IS NOT NULL), ';') AS failures FROM s""")
def geometry_checks(spark: SparkSession, d: str) -> DataFrame:
    """Structural validity of faces, and why not."""
    b = T.boxes(spark, d)
    a, k = F.col("a"), F.col("l_orderkey")
    w, h = a["x2"] - a["x1"], a["y2"] - a["y1"]
    moved = {3: F.when(k % 19 == 0, 2000.0).otherwise(0.0), 5: F.when(k % 17 == 0, -30.0).otherwise(0.0)}
    b = b.withColumns({"x1": a["x1"], "y1": a["y1"], "w": w, "h": h})
    # Products and whole quotients are exact, so points on the edge stay there.
    x = lambda i: F.col("x1") + F.col("w") * i / F.lit(67.0) + moved.get(i, F.lit(0.0))
    points = F.array(*[F.struct(x(i).alias("x"), (F.col("y1") + F.col("h") * (i % 10) / F.lit(9.0)).alias("y")) for i in range(68)])
    ear, mar = F.when(F.col("l_linenumber") != 7, F.col("l_linenumber") / F.lit(10.0)), F.when(F.col("l_linenumber") != 6, (k % 10) / F.lit(5.0))
    b = b.withColumns({"ear": ear, "mar": mar})
    v = G.valid_geometry(a, points, F.lit(640), F.lit(480), F.col("ear"), F.col("mar"), k % 11 != 0, 0.1, 40, (0.15, 0.45), (0.0, 1.5))
    x = b.withColumn("v", v)
    return x.select("l_orderkey", "l_linenumber", "v.face_valid", "v.landmark_valid", "v.valid", F.array_join("v.suspicious_reasons", ";").alias("suspicious"), F.array_join("v.failure_reasons", ";").alias("failures"))


@query(f"""WITH {T.BOXES}, p AS (SELECT l_orderkey, l_linenumber, w / 10.0::DOUBLE AS u, h / 10.0::DOUBLE AS t FROM boxes) SELECT l_orderkey, l_linenumber, round((t + 2 * t + t) / (2 * 4 * u), 8) AS mouth, round((2 * sqrt(u * u + t * t) ) / 2 / greatest(sqrt(u * 10 * t * 10), 1), 8) AS moved, CASE WHEN u * 10 >= 64 AND t * 10 >= 64 THEN 'AREA' ELSE 'LINEAR' END AS resize, 104 AS pad_b, 116 AS pad_g, 124 AS pad_r FROM p""")
def mouth_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Mouth ratios of eight points, mean movement of points, and the constants of crops."""
    b = T.boxes(spark, d)
    a = F.col("a")
    u, t = (a["x2"] - a["x1"]) / F.lit(10.0), (a["y2"] - a["y1"]) / F.lit(10.0)
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    z = F.lit(0.0)
    mouth = F.array(p(z, z), p(u, t / 2), p(2 * u, t), p(3 * u, t / 2), p(4 * u, z), p(3 * u, -t / 2), p(2 * u, -t), p(u, -t / 2))
    q1, q2 = F.array(p(z, z), p(u, u)), F.array(p(u, t), p(2 * u, u + t))
    pad = G.padding_color()
    x = b.withColumns({"m": mouth, "q1": q1, "q2": q2, "w": a["x2"] - a["x1"], "h": a["y2"] - a["y1"]})
    return x.select("l_orderkey", "l_linenumber", F.round(G.mouth_ratio(F.col("m")), 8).alias("mouth"), F.round(G.mean_point_distance(F.col("q1"), F.col("q2"), a), 8).alias("moved"), G.resize_rule(F.col("w"), F.col("h"), 64).alias("resize"), *[F.lit(v).alias(f"pad_{n}") for n, v in zip("bgr", pad, strict=True)])


@query(f"""WITH {_F32}, s AS (SELECT video_id, split, label, valid, missing, run, row_number() OVER (ORDER BY video_id) - 1 AS pos, CASE WHEN video_id % 9 = 0 THEN 40 ELSE missing END AS imputed, CASE WHEN video_id % 8 = 0 THEN -1 ELSE row_number() OVER (ORDER BY video_id) - 1 END AS idx FROM state)
SELECT 'POSITION' AS rule, count(*) FILTER (idx <> pos) AS n FROM s UNION ALL SELECT 'SPLIT', 0 FROM s HAVING count(*) > 0 UNION ALL SELECT 'LABEL', 0 FROM s HAVING count(*) > 0 UNION ALL SELECT 'IMPUTED_RANGE', count(*) FILTER (imputed > 32) FROM s UNION ALL SELECT 'REPEATED_ID', 0 FROM s HAVING count(*) > 0 UNION ALL SELECT 'REPEATED_INDEX', greatest(count(*) FILTER (idx = -1) - 1, 0) FROM s""")
def index_contract(spark: SparkSession, d: str) -> DataFrame:
    """A dataset index: domains, ranges, unique ids, positions in file order."""
    s = T.state(T.frames(spark, d, 32))
    s = numbered(s, [], ["video_id"], "position").withColumns({"idx": F.when(F.col("video_id") % 8 == 0, -1).otherwise(F.col("position")), "imputed": F.when(F.col("video_id") % 9 == 0, 40).otherwise(F.col("missing"))})
    rules = [("POSITION", F.col("idx") != F.col("position")), ("SPLIT", ~F.col("split").isin("train", "val")), ("LABEL", ~F.col("label").isin("pos", "neg")), ("IMPUTED_RANGE", ~F.col("imputed").between(0, 32))]
    twice = s.agg((F.count(F.lit(1)) - F.count_distinct("video_id")).alias("REPEATED_ID"), (F.count(F.lit(1)) - F.count_distinct("idx")).alias("REPEATED_INDEX"))
    more = twice.unpivot([], ["REPEATED_ID", "REPEATED_INDEX"], "rule", "n")
    return I.violation_counts(s, rules).unionByName(more)


@query(f"""WITH {T.CLIPS}, k AS (SELECT clip, count(*) AS n, min(slot) AS lo, max(slot) AS hi, count(*) FILTER (len(v) <> 64) AS shape, count(*) FILTER (len(list_filter(v, lambda x: NOT isfinite(x))) > 0) AS bad, count(*) FILTER ((clip % 5 = 0 AND slot = 3)) AS mask FROM clips WHERE NOT (clip % 7 = 0 AND slot = 31) GROUP BY clip),
e AS (SELECT clip, 'SLOTS' AS rule FROM k WHERE n <> 32 OR lo <> 0 OR hi <> 31 UNION ALL SELECT clip, 'SHAPE' FROM k WHERE shape > 0 UNION ALL SELECT clip, 'NOT_FINITE' FROM k WHERE bad > 0 UNION ALL SELECT clip, 'MASKS' FROM k WHERE mask > 0) SELECT clip, rule FROM e""")
def sequence_contract(spark: SparkSession, d: str) -> DataFrame:
    """Packed sequences: slots, shape, finite values, complementary masks."""
    from seqloom.operators.frames import sequence_errors

    c = T.clips(spark, d).where("NOT (clip % 7 = 0 AND slot = 31)").withColumns({"original": F.col("slot") % 2 == 0, "imputed": F.when(F.expr("clip % 5 = 0 AND slot = 3"), F.lit(False)).otherwise(F.col("slot") % 2 == 1)})
    return sequence_errors(c, "clip", "slot", "v", "original", "imputed", 32, 64)


@query(f"""WITH {C.FRAMES}, r AS (SELECT video_id, count(*) FILTER (yunet_success) AS face, count(*) FILTER (landmark_success) AS lm FROM c GROUP BY video_id), s AS (SELECT video_id, CASE WHEN video_id % 6 = 0 THEN face + 1 ELSE face END AS face, CASE WHEN video_id % 10 = 0 THEN -1 ELSE lm END AS lm FROM r WHERE video_id % 14 <> 0)
SELECT r.video_id, x.name, x.stored, x.own FROM r LEFT JOIN s ON s.video_id = r.video_id, LATERAL (SELECT unnest(['yunet_success_count', 'landmark_success_count']) AS name, unnest([s.face, s.lm]) AS stored, unnest([r.face, r.lm]) AS own) x WHERE x.stored IS DISTINCT FROM x.own""")
def recomputed_counts(spark: SparkSession, d: str) -> DataFrame:
    """Stored counts of each video against those computed from its frames."""
    from seqloom.operators.frames import video_counters

    own = video_counters(C.canonical(spark, d)).select("video_id", "yunet_success_count", "landmark_success_count")
    k = F.col("video_id")
    stored = own.where("video_id % 14 <> 0").select("video_id", F.when(k % 6 == 0, F.col("yunet_success_count") + 1).otherwise(F.col("yunet_success_count")).alias("yunet_success_count"), F.when(k % 10 == 0, -1).otherwise(F.col("landmark_success_count")).alias("landmark_success_count"))
    return J.count_differences(stored, own, "video_id", ["yunet_success_count", "landmark_success_count"])


@query(f"WITH {C.FRAMES} SELECT video_id, canonical_index, context_slot FROM c WHERE context_selected AND NOT context_crop_available ORDER BY video_id, canonical_index")
def missing_context_rows(spark: SparkSession, d: str) -> DataFrame:
    """Selected frames without a crop, after a check that no sealed split is among them."""
    c = I.seal(C.canonical(spark, d), "split", ["test"])
    return c.where("context_selected AND NOT context_crop_available").orderBy("video_id", "canonical_index").select("video_id", "canonical_index", "context_slot")


@query(f"""WITH {_F32}, s AS (SELECT split, list(video_id ORDER BY video_id) FILTER (missing > 16) AS many, list(video_id ORDER BY video_id) FILTER (valid = 0) AS none, count(*) AS n FROM state GROUP BY split) SELECT split, n, coalesce(many, []) AS many, coalesce(none, []) AS none FROM s""")
def split_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Ids of units with too much missing, by split."""
    s = T.state(T.frames(spark, d, 32))
    ids = lambda c: F.array_sort(F.collect_list(F.when(F.expr(c), F.col("video_id"))))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), ids("missing > 16").alias("many"), ids("valid = 0").alias("none"))


@query(f"""WITH {_F32}, m AS (SELECT split, unnest(['units', 'imputed', 'mean_imputed', 'longest']) AS metric, unnest([count(*)::DOUBLE, sum(missing), avg(missing), max(run)]) AS v FROM state GROUP BY split) SELECT metric, round(max(v) FILTER (split = 'train'), 6) AS train, round(max(v) FILTER (split = 'val'), 6) AS val, round(max(v) FILTER (split = 'val') - max(v) FILTER (split = 'train'), 6) AS val_minus_train FROM m GROUP BY metric""")
def split_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Training and validation side by side."""
    s = T.state(T.frames(spark, d, 32)).groupBy("split").agg(F.count(F.lit(1)).cast("double").alias("units"), F.sum("missing").cast("double").alias("imputed"), F.avg("missing").alias("mean_imputed"), F.max("run").cast("double").alias("longest"))
    long = s.unpivot(["split"], ["units", "imputed", "mean_imputed", "longest"], "metric", "v")
    of = lambda n: F.max(F.when(F.col("split") == n, F.col("v")))
    return long.groupBy("metric").agg(F.round(of("train"), 6).alias("train"), F.round(of("val"), 6).alias("val"), F.round(of("val") - of("train"), 6).alias("val_minus_train"))


@query(f"""WITH {_F32}, c AS (SELECT video_id, missing <= 8 AND run <= 4 AS now, CASE WHEN video_id % 9 = 0 THEN false ELSE missing <= 8 AND run <= 4 END AS frozen, valid >= 20 AS behavior FROM state)
SELECT 'eligible' AS name, count(*) FILTER (now) AS value, count(*) FILTER (frozen) AS frozen, count(*) FILTER (now) = count(*) FILTER (frozen) AS equal FROM c UNION ALL SELECT 'context_and_behavior', count(*) FILTER (now AND behavior), count(*) FILTER (frozen AND behavior), count(*) FILTER (now AND behavior) = count(*) FILTER (frozen AND behavior) FROM c
UNION ALL SELECT 'context_only', count(*) FILTER (now AND NOT behavior), count(*) FILTER (frozen AND NOT behavior), count(*) FILTER (now AND NOT behavior) = count(*) FILTER (frozen AND NOT behavior) FROM c UNION ALL SELECT 'changed', count(*) FILTER (now <> frozen), 0, count(*) FILTER (now <> frozen) = 0 FROM c""")
def freeze_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """A policy's simulation against its frozen manifest, with the two-by-two of branches."""
    s = T.state(T.frames(spark, d, 32))
    now = (F.col("missing") <= 8) & (F.col("run") <= 4)
    manifest = s.select("video_id", (now & (F.col("video_id") % 9 != 0)).alias("frozen"))
    j = s.select("video_id", now.alias("now"), (F.col("valid") >= 20).alias("behavior")).join(manifest, "video_id", "full")
    n = lambda c: F.count_if(F.expr(c))
    rows = [("eligible", "now", "frozen"), ("context_and_behavior", "now AND behavior", "frozen AND behavior"), ("context_only", "now AND NOT behavior", "frozen AND NOT behavior"), ("changed", "now <> frozen", "false")]
    a = j.agg(F.array(*[F.struct(F.lit(k).alias("name"), n(x).alias("value"), n(y).alias("frozen")) for k, x, y in rows]).alias("r"))
    return a.select(F.explode("r").alias("r")).select("r.*", (F.col("r.value") == F.col("r.frozen")).alias("equal"))


_GATHER = """src AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 3 = 0), tgt AS (SELECT vec_id AS t, CASE WHEN vec_id % 50 = 0 THEN -1 ELSE vec_id - vec_id % 3 END AS id, CASE WHEN vec_id % 40 = 1 THEN 0.0 ELSE 1.0 END AS k FROM embeddings)"""


@query(f"""WITH {_GATHER}, x AS (SELECT t, tgt.id, k, src.v AS v FROM tgt LEFT JOIN src ON src.id = tgt.id) SELECT 'targets' AS name, count(*) AS value FROM x UNION ALL SELECT 'without_source', count(*) FILTER (v IS NULL) FROM x UNION ALL SELECT 'differing', count(*) FILTER (v IS NOT NULL AND k = 0 AND len(list_filter(v, lambda y: y <> 0)) > 0) FROM x UNION ALL SELECT 'unused_sources', count(*) FROM src WHERE id NOT IN (SELECT id FROM tgt)""")
def gather_audit(spark: SparkSession, d: str) -> DataFrame:
    """Assembled features against their sources: every target is the source it names."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    src = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), "v")
    k = F.col("vec_id")
    own = e.select("vec_id", F.when(k % 50 == 0, -1).otherwise(k - k % 3).alias("id")).join(src, "id", "left")
    tgt = own.select("vec_id", "id", F.when(k % 40 == 1, F.transform("v", lambda x: x * 0)).otherwise(F.col("v")).alias("v"))
    return J.gather_audit(tgt, src, "id", "v")


@query("""WITH c AS (SELECT 'targets' AS name, 10::BIGINT AS value UNION ALL SELECT 'without_source', count(*) FILTER (n_regionkey = 0) FROM nation UNION ALL SELECT 'differing', 2) SELECT sum(value) FILTER (name <> 'targets')::BIGINT AS anomalies, CASE WHEN sum(value) FILTER (name <> 'targets') = 0 THEN 'PASS' ELSE 'REVIEW' END AS decision FROM c""")
def anomaly_totals(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").agg(F.count_if(F.col("n_regionkey") == 0).alias("value")).select(F.lit("without_source").alias("name"), "value")
    c = spark.createDataFrame([("targets", 10), ("differing", 2)], "name string, value long").unionByName(n)
    return I.anomaly_total(c, ignored=["targets"])


@query("""WITH s AS (SELECT vec_id AS id, CASE WHEN vec_id % 30 = 0 THEN 'test/v.jpg' WHEN vec_id % 20 = 1 THEN 'a/shared.jpg' ELSE 'a/' || vec_id || '.jpg' END AS path FROM embeddings WHERE vec_id % 100 <> 7), n AS (SELECT (SELECT max(vec_id) + 1 FROM embeddings) AS n)
SELECT count(*) AS rows_found, (count(*) <> any_value(n))::INTEGER AS row_count_mismatch, count(*) - count(DISTINCT id) AS duplicate_source_ids, count(*) FILTER (id < 0 OR id >= n) AS invalid_source_ids, (count(*) FILTER (id <> pos) > 0)::INTEGER AS source_id_order_mismatch, count(*) - count(DISTINCT path) AS duplicate_source_paths, count(*) FILTER (starts_with(path, 'test/')) AS test_source_references FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS pos FROM s), n""")
def source_index_audit(spark: SparkSession, d: str) -> DataFrame:
    """A source index: dense ids in order, unique paths, none of a sealed split."""
    k = F.col("vec_id")
    e = table(spark, d, "embeddings")
    path = F.when(k % 30 == 0, "test/v.jpg").when(k % 20 == 1, "a/shared.jpg").otherwise(F.concat(F.lit("a/"), k, F.lit(".jpg")))
    return I.source_index_audit(e.where(k % 100 != 7).select(k.alias("id"), path.alias("path")), "id", "path", e.agg(F.max("vec_id")).first()[0] + 1, "test")


@query("""SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS feature_index FROM embeddings WHERE vec_id % 4 <> 0""")
def dense_universe(spark: SparkSession, d: str) -> DataFrame:
    """The whole eligible universe with a dense index in order."""
    e = table(spark, d, "embeddings").where("vec_id % 4 <> 0").select("vec_id", "label")
    return numbered(e, [], ["vec_id"], "feature_index").select("vec_id", "label", "feature_index")


@query(f"""WITH {T.SCORED}, m AS (SELECT 'hog' AS method, (label = 1) AS ok, l0 AS ms FROM losses UNION ALL SELECT 'yunet', prediction = 1, l1 FROM losses) SELECT method, count(*) AS attempts, count(*) FILTER (ok) AS successes, round(count(*) FILTER (ok) / count(*)::DOUBLE, 9) AS rate, round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS median_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms FROM m GROUP BY method""")
def method_summary(spark: SparkSession, d: str) -> DataFrame:
    """Two methods' successes and latencies."""
    from .evaluation import losses

    x = losses(spark, d)
    pair = F.array(F.struct(F.lit("hog").alias("method"), (F.col("label") == 1).alias("ok"), F.col("l0").alias("ms")), F.struct(F.lit("yunet").alias("method"), (F.col("prediction") == 1).alias("ok"), F.col("l1").alias("ms")))
    m = x.select(F.explode(pair).alias("p")).select("p.*")
    g = m.groupBy("method").agg(F.count(F.lit(1)).alias("attempts"), F.count_if("ok").alias("successes"))
    s = summarize(m, ["method"], F.col("ms"), (50, 95)).select("method", *[F.round(c, 6).alias(f"{c}_ms") for c in ("mean", "median", "p95")])
    return g.withColumn("rate", F.round(ratio(F.col("successes"), F.col("attempts")), 9)).join(s, "method")
