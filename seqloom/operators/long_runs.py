"""Runs and falling steps of keys of any length: blocks of slots with carried edges.

``runs`` orders a whole key in one task, which is right for clips of a hundred slots.  Here a
key is cut into blocks of ``BLOCK`` slots.  Runs are found inside the blocks; only those that
touch a block's edge, two a block at most, are put together with their neighbours, and only
counts of blocks, one row each, are added up along the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import same

BLOCK = 4096


def long_runs(df: DataFrame, keys: Sequence[str], order: str, member: Column, sums: Mapping[str, Column] | None = None, block: int = BLOCK) -> DataFrame:
    """Maximal runs of consecutive slots for which ``member`` holds: keys, run_id (from 1), start,
    end, length, and the named sums over a run's rows.

    Slots are integers, one row each, negative ones too; rows whose membership is null are not
    members; null keys are a key of their own.
    """
    sums = dict(sums or {})
    inside = df.where(F.coalesce(member, F.lit(False))).select(*keys, F.col(order).cast("long").alias("slot"), *[c.alias(n) for n, c in sums.items()])
    inside = inside.withColumn("block", F.floor(F.col("slot") / block).cast("long"))
    island = F.col("slot") - F.row_number().over(Window.partitionBy(*keys, "block").orderBy("slot"))
    totals = lambda: [F.sum(n).alias(n) for n in sums]
    pieces = inside.withColumn("island", island).groupBy(*keys, "block", "island").agg(F.min("slot").alias("start"), F.max("slot").alias("end"), F.count(F.lit(1)).alias("length"), *totals()).drop("island")
    from_edge, to_edge = F.col("start") == F.col("block") * block, F.col("end") == F.col("block") * block + block - 1
    shape = [*keys, "start", "end", "length", *sums]
    whole = pieces.where(~from_edge & ~to_edge).select(*shape)
    # Two pieces a block at most; a run goes on if the next piece starts where one ended.
    along = Window.partitionBy(*keys).orderBy("start")
    edge = pieces.where(from_edge | to_edge)
    head = F.coalesce(F.lag("end").over(along) != F.col("start") - 1, F.lit(True))
    number = F.sum(F.col("head").cast("long")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    stitched = edge.withColumn("head", head).withColumn("number", number).groupBy(*keys, "number").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("length"), *totals())
    found = whole.unionByName(stitched.select(*shape)).withColumn("block", F.floor(F.col("start") / block).cast("long"))
    counts = found.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"of_{k}") for k in [*keys, "block"]], before.alias("before"))
    here = F.row_number().over(Window.partitionBy(*keys, "block").orderBy("start"))
    out = found.join(counts, same([*keys, "block"], [f"of_{k}" for k in [*keys, "block"]]))
    return out.select(*shape, (F.col("before") + here).alias("run_id"))


def long_monotone(df: DataFrame, keys: Sequence[str], order: str, value: str, strict: bool = False, block: int = BLOCK) -> DataFrame:
    """Per key the number of steps, in the order of integer slots, at which ``value`` falls (or,
    if strict, does not rise): inside the blocks, and from each block's last slot to the next
    block's first.  A step from or to a null does neither."""
    d = df.select(*keys, F.col(order).cast("long").alias("slot"), F.col(value).alias("v")).withColumn("block", F.floor(F.col("slot") / block).cast("long"))
    bad = lambda now, was: F.coalesce((now <= was) if strict else (now < was), F.lit(False))
    inside = d.withColumn("bad", bad(F.col("v"), F.lag("v").over(Window.partitionBy(*keys, "block").orderBy("slot"))))
    ends = inside.groupBy(*keys, "block").agg(F.count_if("bad").alias("n"), F.min_by("v", "slot").alias("first"), F.max_by("v", "slot").alias("last"))
    step = bad(F.col("first"), F.lag("last").over(Window.partitionBy(*keys).orderBy("block")))
    return ends.withColumn("edge", step.cast("long")).groupBy(*keys).agg(F.sum(F.col("n") + F.col("edge")).alias("violations"))
