"""Grouping sets with names, zero-filled spines, pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube(df: DataFrame, dims: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """All grouping sets of ``dims``; group_type names the set ('overall', 'split', 'split*label')."""
    parts = [F.when(F.grouping(d) == 0, F.lit(d)) for d in dims]
    name = F.concat_ws("*", *parts)
    return df.cube(*dims).agg(*aggs, F.when(name == "", "overall").otherwise(name).alias("group_type"))


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], aggs: Sequence[Column]) -> DataFrame:
    """The given grouping sets only."""
    dims = list(dict.fromkeys(d for s in sets for d in s))
    name = F.concat_ws("*", *[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims])
    return df.groupingSets([[F.col(d) for d in s] for s in sets], *dims).agg(*aggs, F.when(name == "", "overall").otherwise(name).alias("group_type"))


def zero_filled(counts: DataFrame, spine: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The spine's keys with the counts' values, 0 where there are none."""
    joined = spine.join(counts, list(keys), "left")
    return joined.select(*keys, *[F.coalesce(v, F.lit(0)).alias(v) for v in values])


def ratio(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    """a / b; ``empty`` (0 or null) without a denominator."""
    r = F.try_divide(a.cast("double"), b.cast("double"))
    return r if empty is None else F.coalesce(r, F.lit(empty))


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, n for several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n")).select("column", "value", "n")
