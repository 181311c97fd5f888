"""Distribution summaries, dense histograms, cumulative counts, concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import percentiles, same, top_mass

PERCENTS = (1, 5, 50, 75, 90, 95, 99)


def usable(c: Column) -> Column:
    """The value as a double, null unless finite."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def summary_columns(value: Column, percents: Sequence[int] = PERCENTS, prefix: str = "") -> list[Column]:
    """Aggregates: n, min, mean, std (population), exact percentiles, max, over finite values;
    all but n are null without any.  For groups of bounded size (a clip, a run): a group's
    distinct values meet in one map.  ``summarize`` is for groups of any size."""
    v = usable(value)
    all_ = F.percentile(v, F.array(*[F.lit(p / 100) for p in percents]))
    return [
        *_moments(v, prefix), *[F.get(all_, F.lit(i)).alias(f"{prefix}{_name(p)}") for i, p in enumerate(percents)], F.max(v).alias(f"{prefix}max"),
    ]


def _name(p: int) -> str:
    return "median" if p == 50 else f"p{p:02d}"


def _moments(v: Column, prefix: str = "") -> list[Column]:
    return [F.count(v).alias(f"{prefix}n"), F.min(v).alias(f"{prefix}min"), F.avg(v).alias(f"{prefix}mean"), F.stddev_pop(v).alias(f"{prefix}std")]


def summarize(df: DataFrame, groups: Sequence[str], value: Column, percents: Sequence[int] = PERCENTS) -> DataFrame:
    """Per group of any size: n, min, mean, std (population), exact percentiles, max, over finite
    values; all but n are null without any."""
    v = usable(value)
    base = df.groupBy(*groups).agg(*_moments(v), F.max(v).alias("max"))
    found = percentiles(df, groups, v, [(_name(p), p / 100) for p in percents])
    found = found.select(*[F.col(g).alias(f"of_{g}") for g in groups], *[_name(p) for p in percents])
    both = base.join(found, same(groups, [f"of_{g}" for g in groups]), "left")
    return both.select(*groups, "n", "min", "mean", "std", *[_name(p) for p in percents], "max")


def long_form(df: DataFrame, keys: Sequence[str], values: Sequence[str], name: str = "metric") -> DataFrame:
    """One row for each key and value column."""
    return df.unpivot(list(keys), [F.col(v).cast("double").alias(v) for v in values], name, "value")


def dense_histogram(df: DataFrame, value: Column, low: int, high: int) -> DataFrame:
    """value low..high and its count, zeros included."""
    spine = df.sparkSession.range(low, high + 1).select(F.col("id").alias("value"))
    counted = df.groupBy(value.cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return spine.join(counted, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def cumulative_counts(df: DataFrame, value: Column, high: int) -> DataFrame:
    """For each limit 0..high how many values are at most that, and their share.  The window
    runs over the high + 1 rows of the histogram."""
    h = dense_histogram(df, value, 0, high)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    running = F.sum("n").over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return h.withColumn("at_most", running).join(total).select(F.col("value").alias("limit"), "at_most", F.coalesce(F.try_divide(F.col("at_most").cast("double"), F.col("total").cast("double")), F.lit(0.0)).alias("share"))


def concentration(df: DataFrame, value: Column, percents: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """For each percentage the ``ceil(n p %)`` largest values and their share of the total; 0 if
    the total is 0.  Only the range of values in which a top ends is ordered."""
    found = top_mass(df.select(value.cast("double").alias("v")), "v", [(str(p), (p, 100)) for p in percents])
    spine = df.sparkSession.createDataFrame([(p, str(p)) for p in percents], "percent int, name string")
    share = F.coalesce(F.try_divide("mass", "total"), F.lit(0.0))
    return spine.join(found, "name", "left").select("percent", F.coalesce("rows", F.lit(0)).alias("n_top"), share.alias("share"))


def buckets(value: Column, bounds: Sequence[tuple[str, int, int | None]]) -> list[Column]:
    """Aggregates: how many values fall in each named range (both ends included)."""
    return [F.count_if((value >= low) & (F.lit(True) if high is None else value <= high)).alias(name) for name, low, high in bounds]


def share(condition: Column) -> Column:
    """The rate of a condition; 0 without rows."""
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))
