"""Fixed slot grids, nearest-valid substitution, evenly spaced picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions.scalars import half_up


def slot_grid(spark: SparkSession, slots: int, rate: float | None = None) -> DataFrame:
    """slot 0..slots-1 and, with a rate, its target second slot / rate."""
    grid = spark.range(slots).select(F.col("id").cast("int").alias("slot"))
    return grid if rate is None else grid.withColumn("target", F.col("slot") / F.lit(float(rate)))


def source_index(target: Column, fps: Column) -> Column:
    """The source row nearest to a target second; halves go up."""
    return half_up(target * fps).cast("long")


def even_positions(n: Column, k: int) -> Column:
    """k positions spread over 0..n-1, both ends included, halves up; the middle for k = 1."""
    if k == 1:
        return F.array(F.floor(n / 2).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: half_up(i * (n - 1).cast("double") / F.lit(float(k - 1))).cast("int"))


def truncated_positions(n: Column, k: int) -> Column:
    """As ``even_positions``, but cut off instead of rounded."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * (n - 1).cast("double") / F.lit(float(max(k - 1, 1)))).cast("int"))


def on_grid(keys: DataFrame, observed: DataFrame, key: Sequence[str], slots: int) -> DataFrame:
    """Every key with every slot, and what was observed there (null where nothing was).

    A key's observed slots meet in one array, and the empty ones are added to it when the keys
    have been dealt out, so no slot is shuffled, and rows of a key stay together.  The number
    of partitions is set, as their size before the slots are there says little.
    """
    values = [c for c in observed.columns if c not in (*key, "slot")]
    inside = observed.where(F.col("slot").between(0, slots - 1))
    held = inside.groupBy(*key).agg(F.collect_list(F.struct(F.col("slot").cast("int").alias("slot"), *values)).alias("__held"))
    dealt = keys.repartition(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
    j = dealt.join(held, list(key), "left").withColumn("__held", F.coalesce("__held", F.array().cast(held.schema["__held"].dataType)))
    none = [F.lit(None).cast(observed.schema[v].dataType).alias(v) for v in values]
    empty = F.transform(F.array_except(F.sequence(F.lit(0), F.lit(slots - 1)), F.col("__held.slot")), lambda i: F.struct(i.alias("slot"), *none))
    out = j.withColumn("__row", F.explode(F.concat("__held", empty)))
    return out.select(*key, "__row.slot", *[c for c in keys.columns if c not in key], *[f"__row.{v}" for v in values])


def nearest_valid(df: DataFrame, keys: Sequence[str], order: str, valid: Column) -> DataFrame:
    """For every slot the nearest valid one of its key (itself if valid): ``source_slot``, and
    its ``distance``; the earlier of two equally near; null if the key has none.

    Two windows over a key's slots, so no self-join; sources are valid themselves, so no
    substitute is taken from a substitute.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    here = F.when(valid, F.col(order))
    before = F.last(here, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(here, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    d = df.withColumns({"__before": before, "__after": after})
    earlier = F.col("__after").isNull() | (F.col(order) - F.col("__before") <= F.col("__after") - F.col(order))
    source = F.when(F.col("__before").isNotNull() & earlier, F.col("__before")).otherwise(F.col("__after"))
    return d.withColumn("source_slot", source).withColumn("distance", F.abs(F.col(order) - F.col("source_slot"))).drop("__before", "__after")


def substitute(df: DataFrame, keys: Sequence[str], order: str, valid: Column, values: Sequence[str]) -> DataFrame:
    """Slots with the values of their nearest valid slot, source_slot, distance, imputed."""
    filled = nearest_valid(df, keys, order, valid)
    source = df.where(valid).select(*keys, F.col(order).alias("source_slot"), *[F.col(v).alias(f"__{v}") for v in values])
    out = filled.join(source, [*keys, "source_slot"], "left")
    return out.withColumns({v: F.col(f"__{v}") for v in values}).withColumn("imputed", F.col("distance") > 0).drop(*[f"__{v}" for v in values])


def within_duration(times: Column, duration: Column) -> Column:
    """The times in [0, duration); all if the duration is unknown."""
    return F.when(duration.isNull(), times).otherwise(F.filter(times, lambda t: (t >= 0) & (t < duration)))


def near_hint(df: DataFrame, keys: Sequence[str], order: str, wanted: Column, valid: Column, within: int) -> DataFrame:
    """For wanted slots the nearest valid slot at most ``within`` away, the earlier first."""
    near = nearest_valid(df.withColumn("__wanted", wanted), keys, order, valid).where("__wanted")
    return near.withColumn("hint", F.when(F.col("distance") <= within, F.col("source_slot"))).drop("__wanted", "source_slot", "distance")
