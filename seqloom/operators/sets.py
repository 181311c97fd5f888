"""Sets and bags of keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairwise_overlap(df: DataFrame, group: str, key: str) -> DataFrame:
    """For each pair of groups that share keys: a, b, n shared.  Keys are grouped once; a key's
    array holds the groups it stands in, of which there are few."""
    at = df.select(group, key).distinct().groupBy(key).agg(F.array_sort(F.collect_set(group)).alias("g")).where(F.size("g") > 1)
    pairs = F.flatten(F.transform("g", lambda x, i: F.transform(F.slice(F.col("g"), i + 2, F.size("g")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return at.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).select("a", "b", "n")


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionByName(b.exceptAll(a)).distinct()


def union_checked(key: str, *parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All parts' rows, and the keys that stand more than once among them."""
    whole = reduce(DataFrame.unionByName, parts)
    return whole, duplicates(whole, key)


def first_distinct(df: DataFrame, key: str, order: Column, n: int) -> DataFrame:
    """The first row of each key by order, and of those the first n (a top-n, not a sort)."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn").orderBy(order).limit(n)
