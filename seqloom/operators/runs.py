"""Runs of consecutive slots (gaps and islands)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs(df: DataFrame, keys: Sequence[str], order: str, member: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """Maximal runs of consecutive slots for which ``member`` holds: keys, run_id (from 1),
    start, end, length, and the aggregates in ``extra`` over a run's rows.

    The caller states membership, so one operator serves missing and present runs.  Slots
    are integers, one row each; rows whose membership is null are not members.
    """
    inside = df.where(F.coalesce(member, F.lit(False)))
    island = F.col(order) - F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    found = inside.withColumn("__island", island).groupBy(*keys, "__island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("length"), *extra)
    return found.withColumn("run_id", F.row_number().over(Window.partitionBy(*keys).orderBy("start"))).drop("__island")


def run_summary(df: DataFrame, keys: Sequence[str], order: str, member: Column) -> DataFrame:
    """Per key, also those without a run: n_slots, n_member, n_runs, longest_run, first, last,
    touches_start, touches_end."""
    yes = F.coalesce(member, F.lit(False))
    base = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_slots"), F.count_if(yes).alias("n_member"), F.min(F.when(yes, F.col(order))).alias("first"), F.max(F.when(yes, F.col(order))).alias("last"), F.min(order).alias("__low"), F.max(order).alias("__high"))
    longest = runs(df, keys, order, member).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), F.max("length").alias("longest_run"))
    out = base.join(longest, list(keys), "left")
    return out.select(*keys, "n_slots", "n_member", F.coalesce("n_runs", F.lit(0)).alias("n_runs"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"), "first", "last", F.coalesce(F.col("first") == F.col("__low"), F.lit(False)).alias("touches_start"), F.coalesce(F.col("last") == F.col("__high"), F.lit(False)).alias("touches_end"))


def neighbours(df: DataFrame, keys: Sequence[str], order: str, value: str, within: int) -> DataFrame:
    """For every slot the last value before and the first value after it, each at most
    ``within`` slots away (nulls skipped): value_before, value_after.  Slots are dense."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(-within, -1))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(1, within))
    return df.withColumns({"value_before": before, "value_after": after})


def monotone(df: DataFrame, keys: Sequence[str], order: str, value: str, strict: bool = False) -> DataFrame:
    """Per key the number of steps, in the given order, at which ``value`` falls (or, if
    strict, does not rise)."""
    prev = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    bad = (F.col(value) <= prev) if strict else (F.col(value) < prev)
    return df.withColumn("__bad", F.coalesce(bad, F.lit(False))).groupBy(*keys).agg(F.count_if("__bad").alias("violations"))


def transitions(df: DataFrame, keys: Sequence[str], order: str, flag: str, names: tuple[str, str]) -> DataFrame:
    """Each step between neighbours labelled ``from_to`` by the two flags (names: true, false)."""
    yes, no = names
    name = lambda c: F.when(c, yes).otherwise(no)
    prev = F.lag(flag).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__prev", prev).where("__prev IS NOT NULL").withColumn("transition", F.concat(name(F.col("__prev")), F.lit("_to_"), name(F.col(flag)))).drop("__prev")
