"""Moments of vector columns whose partial states merge: no vector is taken apart into rows.

Means and sums of squared deviations are updated and merged (not sums of squares, which lose
all digits of a small variance around a large mean) by Spark's vector summarizer, one state of
the vector's size a group and task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.vectors import mean


def _population(variance: Column, n: Column, squares: Column | None = None) -> Column:
    """The population's variance from the unbiased one (of rows of weights that sum up to n,
    their squares to ``squares``; of single rows the squares are n)."""
    return variance * (n - (n if squares is None else squares) / n) / n


def vector_moments(df: DataFrame, groups: Sequence[str], vector: str) -> DataFrame:
    """Per group: n (vectors), and arrays mean, std (population), low and high by dimension.
    Null vectors count as none; vectors of different sizes in a group are an error."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    m = df.where(F.col(vector).isNotNull()).groupBy(*groups).agg(Summarizer.metrics("count", "mean", "variance", "min", "max").summary(v).alias("m"))
    n = F.col("m.count").cast("double")
    std = F.transform(vector_to_array("m.variance"), lambda x: F.sqrt(_population(x, n)))
    return m.select(*groups, F.col("m.count").alias("n"), vector_to_array("m.mean").alias("mean"), std.alias("std"), vector_to_array("m.min").alias("low"), vector_to_array("m.max").alias("high"))


def element_moments(df: DataFrame, groups: Sequence[str], vector: str) -> DataFrame:
    """Per group over all elements of all its vectors: n, total, min, max, mean, variance
    (population).  Each row gives its vector's own moments; a group's variance is what is
    within the vectors and, by their means weighted by their sizes, between them.  Empty and
    null vectors give nothing."""
    d = df.where(F.size(vector) > 0).select(*groups, F.col(vector).cast("array<double>").alias("v"))
    d = d.withColumn("middle", mean(F.col("v")))
    apart = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x - F.col("middle")) * (x - F.col("middle")))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    d = d.select(*groups, F.size("v").cast("double").alias("size"), "middle", total.alias("sum"), apart.alias("apart"), F.array_min("v").alias("low"), F.array_max("v").alias("high"))
    between = Summarizer.metrics("mean", "variance").summary(array_to_vector(F.array("middle")), F.col("size")).alias("m")
    g = d.groupBy(*groups).agg(F.sum("size").alias("weight"), F.sum(F.col("size") * F.col("size")).alias("squares"), F.sum("sum").alias("total"), F.sum("apart").alias("within"), F.min("low").alias("min"), F.max("high").alias("max"), between)
    first = lambda c: F.get(vector_to_array(c), F.lit(0))
    weight = F.col("weight")
    variance = F.col("within") / weight + _population(first("m.variance"), weight, F.col("squares"))
    return g.select(*groups, weight.cast("long").alias("n"), "total", "min", "max", first("m.mean").alias("mean"), variance.alias("variance"))
