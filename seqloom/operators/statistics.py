"""Ranks, correlations, vector comparisons, and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .moments import vector_moments
from .ordering import same, with_average_ranks


def pearson(a: Column, b: Column) -> Column:
    """An aggregate over complete pairs: null for fewer than two or a constant side."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(F.count(x) >= 2, r)


def correlations(df: DataFrame, a: str, b: str, groups: Sequence[str] = ()) -> DataFrame:
    """Per group over complete pairs: n, pearson, spearman (ties averaged)."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*groups, a, b)
    d = with_average_ranks(d, [(a, "rank_a"), (b, "rank_b")], groups)
    return d.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), pearson(F.col(a), F.col(b)).alias("pearson"), pearson(F.col("rank_a"), F.col("rank_b")).alias("spearman"))


def confusion(df: DataFrame, label: Column, prediction: Column, groups: Sequence[str] = ()) -> DataFrame:
    """Two-class metrics: tn, fp, fn, tp, n, accuracy, macro_f1, and precision, recall and f1
    of class 1.  A ratio without a denominator is 0."""
    y, p = label.cast("int"), prediction.cast("int")
    c = df.groupBy(*groups).agg(F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))
    f1 = lambda t: ratio(2 * t, 2 * t + fp + fn)
    return c.select(*groups, "tn", "fp", "fn", "tp", (tn + fp + fn + tp).alias("n"), ratio(tn + tp, tn + fp + fn + tp).alias("accuracy"), ((f1(tp) + f1(tn)) / 2).alias("macro_f1"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), f1(tp).alias("f1"))


def two_class(l0: Column, l1: Column, label: Column) -> Column:
    """From two logits: p0, p1, prediction (ties: 0), cross entropy of the label, the
    probability of the predicted class, correct."""
    m = F.greatest(l0, l1)
    log_sum = m + F.ln(F.exp(l0 - m) + F.exp(l1 - m))
    p0, p1 = F.exp(l0 - log_sum), F.exp(l1 - log_sum)
    prediction = (l1 > l0).cast("int")
    return F.struct(p0.alias("p0"), p1.alias("p1"), prediction.alias("prediction"), (log_sum - F.when(label == 1, l1).otherwise(l0)).alias("loss"), F.greatest(p0, p1).alias("confidence"), (prediction == label).alias("correct"))


def dimension_shift(df: DataFrame, vector: str, split: str, a: str, b: str, eps: float = 1e-12) -> DataFrame:
    """Per dimension of a vector column: means in two splits and |difference| over the first
    split's population deviation (plus eps)."""
    m = vector_moments(df.where(F.col(split).isin(a, b)), [split], vector)
    # One row a split from here on.
    d = m.select(split, F.posexplode(F.arrays_zip("mean", "std")).alias("dim", "x"))
    of = lambda s, c: F.max(F.when(F.col(split) == s, F.col(f"x.{c}")))
    g = d.groupBy("dim").agg(of(a, "mean").alias("mean_a"), of(a, "std").alias("std_a"), of(b, "mean").alias("mean_b"), of(b, "std").alias("std_b"))
    return g.withColumn("shift", F.abs(F.col("mean_b") - F.col("mean_a")) / (F.col("std_a") + F.lit(eps)))


def mean_vector_comparison(shift: DataFrame) -> DataFrame:
    """From ``dimension_shift``: cosine (null for a zero vector) and distance of the means."""
    ab, aa, bb = F.sum(F.col("mean_a") * F.col("mean_b")), F.sum(F.col("mean_a") * F.col("mean_a")), F.sum(F.col("mean_b") * F.col("mean_b"))
    d = F.col("mean_a") - F.col("mean_b")
    return shift.agg(F.try_divide(ab, F.sqrt(aa) * F.sqrt(bb)).alias("cosine"), F.sqrt(F.sum(d * d)).alias("l2"))


def min_max(df: DataFrame, value: str, groups: Sequence[str], out: str) -> DataFrame:
    """Rows with their value scaled to [0, 1] within its group; 0 for a constant group.  Bounds
    are one row a group, joined to the rows."""
    bounds = df.groupBy(*[F.col(g).alias(f"of_{g}") for g in groups]).agg(F.min(value).alias("of_low"), F.max(value).alias("of_high"))
    d = df.join(bounds, same(groups, [f"of_{g}" for g in groups]))
    scaled = F.try_divide((F.col(value) - F.col("of_low")).cast("double"), (F.col("of_high") - F.col("of_low")).cast("double"))
    return d.withColumn(out, F.coalesce(scaled, F.lit(0.0))).drop("of_low", "of_high", *[f"of_{g}" for g in groups])


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def epoch_series(df: DataFrame, run: str, epoch: str, value: str) -> DataFrame:
    """Per run: mean and largest |step| between epochs, sample deviation, best value, its first
    epoch, last value."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(run).orderBy(epoch)))
    d = df.withColumn("__step", step)
    return d.groupBy(run).agg(F.avg("__step").alias("mean_step"), F.max("__step").alias("max_step"), F.stddev_samp(value).alias("std"), F.min(value).alias("best"), F.min_by(epoch, F.struct(value, epoch)).alias("best_epoch"), F.max_by(value, epoch).alias("final"))


def early_stop(df: DataFrame, run: str, epoch: str, loss: str, patience: int, min_delta: float = 0.0) -> DataFrame:
    """Per run: stop_epoch (null: never) and best_epoch at that time.  The best falls only by
    strictly more than ``min_delta``; training stops after ``patience`` epochs without that.

    An order-dependent state over a run's epochs, folded in one array: a run has as many
    entries as epochs.
    """
    series = df.groupBy(run).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("epoch"), F.col(loss).cast("double").alias("loss")))).alias("s"))
    zero = F.struct(F.lit(float("inf")).alias("best"), F.lit(None).cast("long").alias("best_epoch"), F.lit(0).alias("wait"), F.lit(None).cast("long").alias("stop"))

    def fold(a: Column, x: Column) -> Column:
        better = x["loss"] < a["best"] - F.lit(min_delta)
        wait = F.when(better, 0).otherwise(a["wait"] + 1)
        nxt = F.struct(F.when(better, x["loss"]).otherwise(a["best"]).alias("best"), F.when(better, x["epoch"]).otherwise(a["best_epoch"]).alias("best_epoch"), wait.alias("wait"), F.when(wait >= patience, x["epoch"]).alias("stop"))
        return F.when(a["stop"].isNotNull(), a).otherwise(nxt)

    return series.select(run, F.aggregate("s", zero, fold).alias("r")).select(run, F.col("r.best_epoch").alias("best_epoch"), F.col("r.best").alias("best"), F.col("r.stop").alias("stop_epoch"))
