"""What a named difference rests on: the rules of ``shifts`` with the metrics, rates and counts
that met them, as tables.  Rows are models, labels and splits, so a result has few of them;
``result`` is the same on all.  Sums over a whole table are one row by construction, and only
such rows are joined without a key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shifts as H
from .classify import outside
from .sampling import concentration_of_top, top_k


def metrics_outside(ranges: DataFrame, by: Sequence[str], side: str, compared: str, reference: str, out: str = "outside") -> DataFrame:
    """From (by, side, metric, p10, median, p90): per group the names, in order, of the metrics
    whose median on one side is outside the other side's p10 to p90 (both ends inside).  A
    metric that a side lacks is not outside."""
    of = lambda s, c: F.max(F.when(F.col(side) == F.lit(s), F.col(c)))
    m = ranges.groupBy(*by, "metric").agg(of(compared, "median").alias("m"), of(reference, "p10").alias("low"), of(reference, "p90").alias("high"))
    return m.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(outside(F.col("m"), F.col("low"), F.col("high")), F.col("metric")))).alias(out))


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def feature_shift_evidence(ranges: DataFrame, shifts: DataFrame, models: int, compared: str = "val", reference: str = "train") -> DataFrame:
    """``ranges``: (model, label or null for all labels, split, metric, p10, median, p90);
    ``shifts``: (model, p95 of the dimensions' shifts, cosine of the mean vectors).

    A row for each model: outside, dimension_large, center_large, flag (two signals or more);
    and one for each of its labels with two metrics or more outside (flag; the other two are
    null).  A cosine that is null, of a mean vector of zeros, is no signal.
    """
    out = metrics_outside(ranges, ["model", "label"], "split", compared, reference)
    large, away = _sure(F.col("p95") >= 0.5), _sure(F.col("cosine") < 0.99)
    signals = F.size("outside") + large.cast("int") + away.cast("int")
    whole = out.where("label IS NULL").join(shifts, "model").select("model", "label", "outside", large.alias("dimension_large"), away.alias("center_large"), (signals >= 2).alias("flag"), (signals > 0).alias("some"))
    none = F.lit(None).cast("boolean")
    parts = out.where("label IS NOT NULL AND size(outside) >= 2").select("model", "label", "outside", none.alias("dimension_large"), none.alias("center_large"), F.lit(True).alias("flag"), none.alias("some"))
    rows = whole.unionByName(parts)
    all_ = rows.agg(F.count_if(F.col("label").isNull() & F.col("flag")).alias("flagged"), (F.count_if(F.col("label").isNotNull()) > 0).alias("conditional"), _sure(F.bool_or("some")).alias("any_signal"))
    result = H.feature_shift(F.col("flagged"), models, F.col("conditional"), F.col("any_signal"))
    return rows.drop("some").crossJoin(all_.select(result.alias("result")))


def temporal_evidence(ranges: DataFrame, near: DataFrame, labels: tuple[str, str], compared: str = "val", reference: str = "train") -> DataFrame:
    """``ranges`` as above; ``near``: (model, split, rate of steps between near-equal vectors).

    Rows by criterion: 'split' (a model's metrics outside; flag for two or more), 'redundancy'
    (flag if the rate is 0.8 or more in every split), 'label' (in a model's split, metrics of
    the second label outside the first's range, and in ``other_outside`` the other way round;
    flag for two different ones or more).
    """
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    row = lambda c, split, a, b, flag: [F.lit(c).alias("criterion"), F.col("model"), split.alias("split"), a.alias("outside"), b.alias("other_outside"), flag.alias("flag")]
    whole = metrics_outside(ranges.where("label IS NULL"), ["model"], "split", compared, reference).select(*row("split", none, F.col("outside"), empty, F.size("outside") >= 2))
    often = near.groupBy("model").agg((F.min("rate") >= 0.8).alias("often")).select(*row("redundancy", none, empty, empty, _sure(F.col("often"))))
    first, second = labels
    by = ["model", "split"]
    parts = ranges.where(F.col("label").isin(first, second))
    both = metrics_outside(parts, by, "label", second, first).join(metrics_outside(parts, by, "label", first, second, "other"), by)
    label = both.select(*row("label", F.col("split"), F.col("outside"), F.col("other"), F.size(F.array_union("outside", "other")) >= 2))
    rows = whole.unionByName(often).unionByName(label)
    met = lambda c: _sure(F.bool_or(F.when(F.col("criterion") == c, F.col("flag"))))
    all_ = rows.agg(met("split").alias("a"), met("redundancy").alias("b"), met("label").alias("c"))
    return rows.crossJoin(all_.select(H.temporal_pattern(F.col("a"), F.col("b"), F.col("c")).alias("result")))


def loss_evidence(samples: DataFrame, key: str, models: Sequence[tuple[str, str, str]], top: int = 20) -> DataFrame:
    """One row for two models (name, loss column, column that says whether it was right): each
    one's share of loss in its top 10 % (``share_<name>``), how many samples both have wrong, one
    alone has wrong, and both have among their ``top`` highest losses (ties by key), the three
    criteria, and the result.  Without samples shares and counts are 0."""
    (a, loss_a, right_a), (b, loss_b, right_b) = models
    wrong_a, wrong_b = ~F.col(right_a), ~F.col(right_b)
    k = samples.agg(F.count_if(wrong_a & wrong_b).alias("both_incorrect"), F.count_if(wrong_a & ~wrong_b).alias(f"{a}_only_incorrect"), F.count_if(~wrong_a & wrong_b).alias(f"{b}_only_incorrect"))
    for name, loss in ((a, loss_a), (b, loss_b)):
        k = k.crossJoin(concentration_of_top(samples, loss, (("top", 0.1),)).agg(F.max("share").alias(f"share_{name}")))
    high = lambda loss: top_k(samples.select(key, loss), [F.desc(loss), F.col(key)], top).select(key)
    k = k.crossJoin(high(loss_a).join(high(loss_b), key).agg(F.count(F.lit(1)).alias("both_high_loss")))
    share = F.greatest(f"share_{a}", f"share_{b}")
    alone = F.col(f"{a}_only_incorrect") + F.col(f"{b}_only_incorrect")
    result = H.loss_result(share, F.col("both_high_loss"), F.col(f"{a}_only_incorrect"), F.col(f"{b}_only_incorrect"), F.col("both_incorrect"))
    return k.select("*", (share >= 0.5).alias("concentrated"), (F.col("both_high_loss") >= 10).alias("shared"), (alone > F.col("both_incorrect")).alias("model_specific"), result.alias("result"))


def review_evidence(answers: DataFrame, by: Sequence[str], hard: str, quality: Sequence[str], brief: str, concern: str) -> DataFrame:
    """Per group of reviewed samples, from booleans (null: not answered; ``hard``: hard sample or
    control): the quality fields that hold (half or more of the hard samples, 0.2 above the
    controls), the patterns matched, and the result.  A side without answers holds nothing."""
    names = {True: "hard", False: "control"}
    rate = lambda h, c: F.avg(F.when(F.col(hard) == F.lit(h), F.col(c).cast("double"))).alias(f"{c}_{names[h]}")
    g = answers.groupBy(*by).agg(*[rate(h, c) for c in [*quality, brief, concern] for h in (True, False)])
    pair = lambda c: (F.col(f"{c}_hard"), F.col(f"{c}_control"))
    holds = lambda c: (pair(c)[0] >= 0.5) & (pair(c)[0] - pair(c)[1] >= 0.2)
    repeated = F.array_compact(F.array(*[F.when(holds(c), F.lit(c)) for c in quality]))
    matched = F.array_compact(F.array(F.when(F.size(repeated) > 0, "VISUAL_DATA_QUALITY_PATTERN"), F.when(holds(brief), "BRIEF_OR_AMBIGUOUS_TEMPORAL_CUES"), F.when(holds(concern), "POSSIBLE_LABEL_AMBIGUITY")))
    return g.select(*by, repeated.alias("repeated_quality_fields"), matched.alias("matched_patterns"), H.review_result([pair(c) for c in quality], pair(brief), pair(concern)).alias("result"))
