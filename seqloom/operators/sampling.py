"""Deterministic selection: top-k, strata, round robin, without reuse, into groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered, top_mass


def top_k(df: DataFrame, order: Sequence[Column], k: int, groups: Sequence[str] = ()) -> DataFrame:
    """The first k rows by a total order, in each group; rank from 1.  Spark keeps k rows a group
    and task before it shuffles, so no group is sorted as a whole."""
    if groups:
        rn = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
        return df.withColumn("rank", rn).where(F.col("rank") <= k)
    first = df.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def concentration_of_top(df: DataFrame, loss: str, tops: Sequence[tuple[str, int | float]]) -> DataFrame:
    """For each named top by loss (a count, or a fraction of the rows, rounded up): rows, their
    loss and its share of the total; zeros without rows."""
    spine = df.sparkSession.createDataFrame([(name,) for name, _ in tops], "top string")
    found = top_mass(df, loss, tops).withColumnRenamed("name", "top")
    zero = F.lit(0.0)
    return spine.join(found, "top", "left").select("top", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("mass", zero).alias("loss"), F.coalesce(F.try_divide("mass", "total"), zero).alias("share"))


def seeded_order(seed: int, *columns: str) -> Column:
    """A fixed pseudo-random order of rows."""
    return F.xxhash64(F.lit(seed), *columns)


def round_robin(df: DataFrame, strata: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """n rows dealt in turn from the strata: first each stratum's first row, then the second.
    Only n rows of a stratum can be dealt, and only those are sorted together."""
    rn = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    dealt = df.withColumn("turn", rn).where(F.col("turn") <= n)
    return dealt.orderBy("turn", *strata).limit(n)


def evenly_spaced(df: DataFrame, strata: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k rows of each stratum, spread over its ascending order with both ends included, the
    middle one for k = 1.  Only the ranges that hold one of the places are ordered."""
    places = lambda n: [F.floor(n / 2)] if k == 1 else [F.floor(j * (n - 1).cast("double") / float(k - 1) + 0.5) for j in range(k)]
    keep, hit = F.lit(False), F.lit(False)
    for at in places(F.col("total")):
        keep = keep | ((at >= F.col("first")) & (at < F.col("first") + F.col("held")))
        hit = hit | (F.col("place_in_stratum") == at)
    return numbered(df, strata, order, "place_in_stratum", keep).where(hit).select(*df.columns)


def without_reuse(df: DataFrame, key: str, reasons: Sequence[tuple[str, Column, Sequence[Column], int]], strata: Sequence[str] = ()) -> DataFrame:
    """For each reason in turn, its quota of rows by its order (dealt from strata, if given), no
    key twice: key, reason, place.  One pass a reason over what is left; what was taken, at
    most the quotas' sum, is kept on the driver between passes."""
    taken: list = []
    rows: list[tuple] = []
    for name, condition, order, quota in reasons:
        left = df.where(condition)
        if taken:
            left = left.where(~F.col(key).isin(taken))
        picked = round_robin(left, strata, order, quota) if strata else left.orderBy(*order).limit(quota)
        for i, r in enumerate(picked.select(key).collect()):
            taken.append(r[0])
            rows.append((r[0], name, i + 1))
    return df.sparkSession.createDataFrame(rows, f"{key} {df.schema[key].dataType.simpleString()}, reason string, place int")
