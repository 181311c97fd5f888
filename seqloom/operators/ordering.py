"""Places in an order, for groups of any size: no window runs over a whole group.

Distinct values are counted first and cut into ranges.  Sums of whole ranges are added up in
a window with one row a range; inside a range a window has only the range's rows.  The cuts
are found before, by sketches of numbers or a sample that hashes choose, and are constants of
the plan, so they are the same whenever a lost executor's part is computed again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Sampled values for each range, and ranges at most.
SAMPLED, MOST_RANGES = 20, 400


def _ranges(df: DataFrame) -> int:
    return min(MOST_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _spread(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[list, bool]]:
    """For each number column: its cuts, and whether it has few values.  One pass for all of
    them, without a shuffle of values: quantile sketches and distinct counts, one state a task.

    Cuts are quantiles of the rows, so no range has more rows, and the less distinct values,
    than its share; a value that fills several ranges is one cut."""
    ranges = _ranges(df)
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)] or [F.lit(0.5)])
    aggregates = [f for c in columns for f in (F.percentile_approx(c, shares, 20 * max(ranges, 100)), F.approx_count_distinct(c))]
    found = df.agg(*aggregates).first()
    return {c: (sorted(set(found[2 * i] or [])), found[2 * i + 1] <= SAMPLED * ranges // 2) for i, c in enumerate(columns)}


def _sampled(df: DataFrame, column: str) -> tuple[list, bool]:
    """The same for values of any type: those of the smallest hashes, some twenty a range."""
    ranges = _ranges(df)
    h = F.xxhash64(column)  # the top rows of each task, whatever the input's size
    chosen = df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(h, column).limit(SAMPLED * ranges).collect()
    found = sorted({r[0] for r in chosen})
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if len(found) > 1 else [], len(chosen) < SAMPLED * ranges


def value_cuts(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[list, bool]]:
    """Values that cut those of each column (nulls aside) into ranges, about as many as there
    are shuffle partitions, and whether it has so few that each may be a range of its own."""
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    return {**(_spread(df, numbers) if numbers else {}), **{c: _sampled(df, c) for c in columns if c not in numbers}}


def cuts(df: DataFrame, column: str) -> list:
    """The cuts of one column."""
    return value_cuts(df, [column])[column][0]


def row_cuts(rows: DataFrame, order: Sequence[str]) -> list[tuple[int, Column]]:
    """Places in an order of several columns (nulls first) that cut the rows into about as many
    ranges as there are shuffle partitions, for ``row_range``: how many columns a cut looks at,
    and their values.  A cut looks at the first column alone unless one value of it fills
    more than a range; then the next columns cut it.  Rows are sampled by a hash of all of
    them: some twenty a range go through the driver."""
    ranges = _ranges(rows)
    every = max(1, rows.count() // (SAMPLED * ranges))
    chosen = rows.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).select(*order).distinct().orderBy(*order).collect()
    kinds = [rows.schema[c].dataType for c in order]
    at = sorted({len(chosen) * i // ranges for i in range(1, ranges)} - {0}) if len(chosen) > 1 else []
    first = [chosen[i][0] for i in at]
    depth = [len(order) if first.count(v) > 1 else 1 for v in first]
    return [(k, F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in list(zip(chosen[i], kinds, order, strict=True))[:k]])) for i, k in zip(at, depth, strict=True)]


def row_range(order: Sequence[str], at: list[tuple[int, Column]]) -> Column:
    """How many of the cuts are at or below a row, found by halving."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        k, cut = at[middle]
        return F.when(F.struct(*order[:k]) < cut, within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(at))


def range_of(value: Column, at: list) -> Column:
    """How many of the sorted cuts are at or below the value, found by halving."""

    def within(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(at[middle]), within(low, middle)).otherwise(within(middle + 1, high))

    return within(0, len(at))


def same(a: Sequence[str], b: Sequence[str]) -> Column:
    """Whether columns agree in turn, nulls as values."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def value_counts_before(df: DataFrame, groups: Sequence[str], value: str, keep: Column | None = None, known: tuple[list, bool] | None = None) -> DataFrame:
    """Per group and value that is not null: ``n`` rows of it, ``before`` rows of smaller values,
    and ``total`` rows of the group.

    ``keep`` may rule out ranges by their columns first, rows before it, held rows in it and
    total, so that only the ranges that matter are ordered.  ``known`` are the column's entry
    of ``value_cuts``, where it has been found before.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    at, few_values = known or value_cuts(df, [value])[value]
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    if few_values:  # each is a range, and a group has no more rows
        before = F.coalesce(F.sum("n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        few = counts.withColumns({"first": before, "held": F.col("n"), "total": F.sum("n").over(whole)})
        few = few if keep is None else few.where(keep)
        return few.select(*groups, value, "n", F.col("first").alias("before"), "total")
    counts = counts.withColumn("part", range_of(F.col(value), at))
    sums = counts.groupBy(*groups, "part").agg(F.sum("n").alias("held"))
    up = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"first": F.coalesce(F.sum("held").over(up), F.lit(0)), "total": F.sum("held").over(whole)})
    if keep is not None:
        sums = sums.where(keep)
    sums = sums.select(*[F.col(g).alias(f"of_{g}") for g in groups], F.col("part").alias("of_part"), "first", "total")
    both = counts.join(sums, same([*groups, "part"], [f"of_{g}" for g in [*groups, "part"]]))
    inside = Window.partitionBy(*groups, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return both.select(*groups, value, "n", (F.col("first") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"), "total")


def percentiles(df: DataFrame, groups: Sequence[str], value: Column, wanted: Sequence[tuple[str, float]]) -> DataFrame:
    """Exact percentiles (name, fraction) per group, between the two nearest rows."""
    d = df.select(*groups, value.cast("double").alias("ordered_value"))
    place = lambda p, total: F.lit(p) * (total - 1)
    first, held, total = F.col("first"), F.col("held"), F.col("total")
    keep = F.lit(False)
    for _, p in wanted:
        at = place(p, total)
        keep = keep | ((F.floor(at) < first + held) & (F.ceil(at) >= first))
    c = value_counts_before(d, groups, "ordered_value", keep)
    out = []
    for name, p in wanted:
        at = place(p, F.col("total"))
        near = lambda row: F.max(F.when((F.col("before") <= row) & (row < F.col("before") + F.col("n")), F.col("ordered_value")))
        low, high = near(F.floor(at)), near(F.ceil(at))
        out.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return c.groupBy(*groups).agg(*out)


def top_mass(df: DataFrame, value: str, sizes: Sequence[tuple[str, int | float | tuple[int, int]]], groups: Sequence[str] = ()) -> DataFrame:
    """Per group and named size (a count of rows, or a fraction of them as one number or as
    numerator and denominator, rounded up): ``rows`` in
    the top by value, their ``mass`` (sum of values), and the ``total`` mass of the group.

    Ranges of values are summed up as a whole, rows and mass; only the range in which a top
    ends is ordered, value by value, and rows of that value count as far as they reach.  No
    task holds more than a range, however large the top is.  Nulls are no rows.
    """
    d = df.select(*groups, F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    counts = d.groupBy(*groups, "v").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("part", range_of(F.col("v"), cuts(d, "v")))
    sums = counts.groupBy(*groups, "part").agg(F.sum("n").alias("held"), F.sum(F.col("n") * F.col("v")).alias("mass"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    down = whole.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"first": F.coalesce(F.sum("held").over(down), F.lit(0)), "above": F.coalesce(F.sum("mass").over(down), F.lit(0.0)), "all": F.sum("held").over(whole), "total": F.sum("mass").over(whole)})

    def size(k: int | float | tuple[int, int]) -> Column:
        if isinstance(k, tuple):
            return F.least(F.floor((F.col("all") * k[0] + (k[1] - 1)) / k[1]), F.col("all"))
        return F.ceil(F.col("all").cast("double") * k) if isinstance(k, float) else F.least(F.lit(k), F.col("all"))

    named = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), size(k).cast("long").alias("rows")) for name, k in sizes])).alias("top")
    sums = sums.select("*", named).where((F.col("top.rows") > F.col("first")) & (F.col("top.rows") <= F.col("first") + F.col("held")))
    ends = sums.select(*[F.col(g).alias(f"of_{g}") for g in groups], F.col("part").alias("of_part"), F.col("top.name").alias("name"), F.col("top.rows").alias("rows"), "first", "above", "total")
    both = counts.join(ends, same([*groups, "part"], [f"of_{g}" for g in [*groups, "part"]]))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*groups, "part", "name").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reach = F.greatest(F.lit(0), F.least(F.col("n"), F.col("rows") - F.col("first") - before))
    both = both.select(*groups, "name", "rows", "above", "total", (reach * F.col("v")).alias("part_mass"))
    return both.groupBy(*groups, "name", "rows", "above", "total").agg((F.col("above") + F.sum("part_mass")).alias("mass")).select(*groups, "name", "rows", "mass", "total")


def with_average_ranks(df: DataFrame, ranks: Sequence[tuple[str, str]], groups: Sequence[str], base: int = 1) -> DataFrame:
    """Rows with the rank of each (value, out) in its group, ties averaged, from ``base``; null
    for null values.  The cuts of all values come from one pass, and each value's counts from
    the rows as given, not from those that another rank was joined to."""
    known = value_cuts(df, [v for v, _ in ranks])
    out = df
    for value, name in ranks:
        c = value_counts_before(df.select(*groups, value), groups, value, known=known[value])
        rank = F.col("before") + (F.col("n") - 1) / F.lit(2.0) + F.lit(float(base))
        c = c.select(*[F.col(g).alias(f"of_{g}") for g in groups], F.col(value).alias("of_value"), rank.alias(name))
        out = out.join(c, same(groups, [f"of_{g}" for g in groups]) & (F.col(value) == F.col("of_value")), "left").drop("of_value", *[f"of_{g}" for g in groups])
    return out


def with_average_rank(df: DataFrame, value: str, groups: Sequence[str], out: str, base: int = 1) -> DataFrame:
    """The same for one value."""
    return with_average_ranks(df, [(value, out)], groups, base)


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[str], out: str, keep: Column | None = None) -> DataFrame:
    """Rows with their number in the group, from 0, ascending by ``order`` (nulls first), and
    ``total``.  ``keep`` as in ``value_counts_before``: other ranges' rows go.  The columns of
    the order have to be the same whenever the rows are computed again."""
    placed = df.withColumn("of_range", row_range(order, row_cuts(df, order)))
    sums = placed.groupBy(*groups, "of_range").agg(F.count(F.lit(1)).alias("held"))
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    up = whole.orderBy("of_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"first": F.coalesce(F.sum("held").over(up), F.lit(0)), "total": F.sum("held").over(whole)})
    if keep is not None:
        sums = sums.where(keep)
    sums = sums.select(*[F.col(g).alias(f"in_{g}") for g in [*groups, "of_range"]], "first", "total")
    both = placed.join(sums, same([*groups, "of_range"], [f"in_{g}" for g in [*groups, "of_range"]]))
    inside = Window.partitionBy(*groups, "of_range").orderBy(*order)
    number = F.col("first") + F.row_number().over(inside) - 1
    return both.withColumn(out, number.cast("long")).drop("of_range", "first", *[f"in_{g}" for g in [*groups, "of_range"]])
