"""Candidate missing-data policies, eligibility, retention and their comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (name, most missing, longest missing run or none).
CONTEXT = (("C0", 0, 0), ("C1", 2, 1), ("C2", 4, 2), ("C3", 8, 4), ("C4", 8, None))
#: Fixed values: (name, fewest valid, longest missing run or none).
BEHAVIOR = (("B0", 1, None), ("B1", 90, 10), ("B2", 95, 5), ("B3", 80, 20))
NO_GUARD = 2_147_483_647


def candidates(spark: SparkSession, table: Sequence[tuple[str, int, int | None]]) -> DataFrame:
    """A policy table as rows: candidate, bound, run_bound."""
    return spark.createDataFrame([(c, n, NO_GUARD if r is None else r) for c, n, r in table], "candidate string, bound int, run_bound int")


def context_eligible(valid: Column, missing: Column, run: Column, most: Column, longest: Column) -> Column:
    """Something is valid, and neither too much nor too long a stretch is missing."""
    return (valid > 0) & (missing <= most) & (run <= longest)


def behavior_eligible(valid: Column, run: Column, fewest: Column, longest: Column) -> Column:
    return (valid >= fewest) & (run <= longest)


def per_candidate(df: DataFrame, table: Sequence[tuple[str, int, int | None]], build) -> DataFrame:
    """Every row with every candidate of a fixed policy table (an array in the plan, not a
    join): candidate and eligible, as ``build(bound, run_bound)`` says."""
    rows = F.array(*[F.struct(F.lit(c).alias("candidate"), F.lit(n).alias("bound"), F.lit(NO_GUARD if r is None else r).alias("run_bound")) for c, n, r in table])
    d = df.withColumn("__c", F.explode(rows))
    return d.withColumns({"candidate": F.col("__c.candidate"), "eligible": build(F.col("__c.bound"), F.col("__c.run_bound"))}).drop("__c")


def exclusion_reason(valid: Column, count_fails: Column, run_fails: Column) -> Column:
    """Why a row is not eligible; NONE if it is."""
    return F.when(valid == 0, "NO_VALID").when(count_fails & run_fails, "COUNT_AND_RUN").when(count_fails, "COUNT").when(run_fails, "RUN").otherwise("NONE")


def edge_reasons(*pairs: tuple[Column, str]) -> Column:
    """The reasons that hold, joined by ';'."""
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs])), ";")


def retention(df: DataFrame, dims: Sequence[str]) -> DataFrame:
    """From ``per_candidate`` rows: total, kept and rate for each candidate and grouping set."""
    from .rollup import cube, ratio

    sets = cube(df, ["candidate", *dims], [F.count(F.lit(1)).alias("total"), F.count_if("eligible").alias("kept")]).where("candidate IS NOT NULL")
    return sets.withColumn("rate", ratio(F.col("kept"), F.col("total"))).withColumn("group_type", F.regexp_replace(F.regexp_replace("group_type", "^candidate\\*?", ""), "^$", "overall"))


def impact(df: DataFrame, dim: str) -> DataFrame:
    """Per candidate: overall rate, smallest rate of a stratum of ``dim``, and the largest shift
    of a stratum's share, in percentage points."""
    per = df.groupBy("candidate", dim).agg(F.count(F.lit(1)).alias("total"), F.count_if("eligible").alias("kept"))
    whole = per.groupBy("candidate").agg(F.sum("total").alias("all_total"), F.sum("kept").alias("all_kept"))
    j = per.join(whole, "candidate")
    div = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    shift = F.abs(100.0 * (div("kept", "all_kept") - div("total", "all_total")))
    return j.groupBy("candidate").agg(F.max(div("all_kept", "all_total")).alias("rate"), F.min(div("kept", "total")).alias("min_stratum_rate"), F.max(F.when(F.col("all_kept") > 0, shift).otherwise(0.0)).alias("max_shift"))
