"""Array arithmetic with higher-order functions; no Python on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def mean(a: Column) -> Column:
    return F.try_divide(_sum(a), F.size(a).cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def cosine(a: Column, b: Column) -> Column:
    """Clipped to [-1, 1]; null for a vector of zeros."""
    c = F.try_divide(dot(a, b), l2(a) * l2(b))
    return F.when(c.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def pop_std(a: Column) -> Column:
    m = mean(a)
    return F.sqrt(F.greatest(F.lit(0.0), F.try_divide(dot(a, a), F.size(a).cast("double")) - m * m))


def all_zero(a: Column) -> Column:
    return F.forall(a, lambda x: x == 0)


def bad_counts(a: Column) -> Column:
    """How many elements are NaN, infinite, zero."""
    count = lambda test: F.size(F.filter(a, test)).cast("long")
    return F.struct(count(F.isnan).alias("nan"), count(lambda x: F.abs(x) == float("inf")).alias("inf"), count(lambda x: x == 0).alias("zero"))


#: The smallest normal 32-bit float, below which a value counts as that much, and
#: the pairs of tolerances (relative, absolute) that are tried.
FLOAT_TINY = 1.1754943508222875e-38
TOLERANCES = ((1e-6, 1e-7), (1e-5, 1e-6), (1e-4, 1e-5))


def difference_stats(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-6, tolerances: Sequence[tuple[float, float]] = TOLERANCES) -> Column:
    """How far two arrays are apart, element by element: max_abs, mean_abs, median_abs, rmse,
    max_relative (against a, floored at FLOAT_TINY), nonzero, exact, close and failed (elements
    beyond atol + rtol * |b|), and for each of ``tolerances`` whether all elements keep it.

    Arrays of different lengths are refused, nothing is padded; of an empty pair the maxima are
    0 and the means null.  As for floats elsewhere, NaN is close to nothing, and an infinity
    only to itself.
    """
    double = lambda x: x.cast("double")
    d = F.zip_with(a, b, lambda x, y: F.abs(double(x) - double(y)))
    n = F.size(a)
    s = F.array_sort(d)
    median = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0
    relative = F.zip_with(a, b, lambda x, y: F.abs(double(x) - double(y)) / F.greatest(F.abs(double(x)), F.lit(FLOAT_TINY)))
    finite = lambda x: ~F.isnan(double(x)) & (F.abs(double(x)) < float("inf"))

    def near(x: Column, y: Column, r: float, t: float) -> Column:
        within = F.abs(double(x) - double(y)) <= t + r * F.abs(double(y))
        return F.when(finite(x) & finite(y), within).otherwise((double(x) == double(y)) & ~F.isnan(double(x)))

    kept = lambda r, t: F.zip_with(a, b, lambda x, y: near(x, y, r, t))
    tried = F.array(*[F.struct(F.lit(r).alias("rtol"), F.lit(t).alias("atol"), F.forall(kept(r, t), lambda x: x).alias("pass")) for r, t in tolerances])
    failed = F.size(F.filter(kept(rtol, atol), lambda x: ~x)).cast("long")
    most = lambda x: F.coalesce(F.array_max(x), F.lit(0.0))
    stats = F.struct(
        most(d).alias("max_abs"), mean(d).alias("mean_abs"), median.alias("median_abs"), F.sqrt(F.try_divide(dot(d, d), n.cast("double"))).alias("rmse"),
        most(relative).alias("max_relative"), F.size(F.filter(d, lambda x: x != 0)).cast("long").alias("nonzero"), F.forall(F.zip_with(a, b, lambda x, y: (x == y) & ~F.isnan(double(x))), lambda x: x).alias("exact"), (failed == 0).alias("close"),
        failed.alias("failed"), tried.alias("tolerances"),
    )
    refused = F.raise_error(F.concat(F.lit("arrays of "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string"), F.lit(" elements")))
    return F.when(F.size(a) != F.size(b), refused).otherwise(stats)


def scaled(a: Column, mean_: float, std: float) -> Column:
    """(x / 255 - mean) / std of each element."""
    return F.transform(a, lambda x: (x.cast("double") / 255.0 - mean_) / std)


def and_masks(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x & y)


def mismatches(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x)).cast("long")


def longest_true(mask: Column) -> Column:
    """Length of the longest run of true in a boolean array."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(x, s["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(mask, zero, step, lambda s: s["best"])


def spatial_mean(a: Column) -> Column:
    """The mean of each channel of a (channels, height, width) array."""
    return F.transform(a, lambda c: mean(F.flatten(c)))


def channels(a: Column, n: int) -> Column:
    """A vector of n values; null for another size (a classifier's output, a flattened map)."""
    return F.when(F.size(a) == n, a)
