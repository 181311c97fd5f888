"""Fingerprint trees: which part of a large ordered table differs from another version of it.

Rows are hashed in blocks of ``FAN_OUT`` neighbours of a row number; every level above hashes
as many nodes of the one below, up to a single root.  No task holds more than one node's
children.  Two versions are compared from the root down: only children of nodes that differ are
looked at, so one changed row in 10^12 costs a few thousand hashes, not a join of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.functions.hashing import flagged, joined_hashes
from seqloom.sources.sinks import scratch

FAN_OUT = 1024


def _rows(df: DataFrame, order: str, columns: tuple[str, ...]) -> DataFrame:
    return df.select(F.col(order).cast("long").alias("node"), F.sha2(F.concat_ws("\n", *flagged(*columns)), 256).alias("h"))


def fingerprint_tree(df: DataFrame, order: str, *columns: str, fan_out: int = FAN_OUT) -> DataFrame:
    """level (from 1), node, h and n (rows below) of the tree over a unique number from 0 on.

    A node of level k holds the rows whose number, divided by fan_out ** k, is the node's.
    Every level is written once; a table without rows has no nodes.
    """
    spark = df.sparkSession
    path, level = scratch(spark, "fingerprints"), 1
    below = _rows(df, order, columns).withColumn("n", F.lit(1).cast("long"))
    while True:
        up = below.groupBy(F.floor(F.col("node") / fan_out).cast("long").alias("up")).agg(joined_hashes("node", "h").alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "node")
        up.write.parquet(f"{path}/level={level}")
        below = spark.read.schema(up.schema).parquet(f"{path}/level={level}")
        size = below.agg(F.count(F.lit(1)).alias("n"), F.max("node").alias("top")).first()
        if size["n"] == 0 or size["top"] == 0:
            break
        level += 1
    whole = spark.read.schema("node long, h string, n long, level int").option("basePath", path).parquet(path)
    return whole.select("level", "node", "h", "n")


def differing_blocks(old: DataFrame, new: DataFrame, fan_out: int = FAN_OUT) -> DataFrame:
    """node: the blocks (nodes of level 1) in which two trees differ, found from the root down."""
    tops = [t.agg(F.max("level")).first()[0] or 0 for t in (old, new)]
    top = max(tops)
    at = lambda t, level: t.where(F.col("level") == level).select("node", "h")

    def apart(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.withColumnRenamed("h", "g")
        return a.join(b, "node", "full").where(~F.col("h").eqNullSafe(F.col("g"))).select("node")

    if top == 0:
        return old.select("node").limit(0)
    live = apart(at(old, top), at(new, top))
    for level in range(top - 1, 0, -1):
        if level >= min(tops):  # the smaller tree ends here: its root stands for node 0
            live = apart(at(old, level), at(new, level))
            continue
        parents = live.select(F.col("node").alias("up"))
        below = lambda t: at(t, level).withColumn("up", F.floor(F.col("node") / fan_out).cast("long")).join(parents, "up", "left_semi").select("node", "h")  # noqa: B023, E731
        live = apart(below(old), below(new))
    return live


def differing_rows(old: DataFrame, new: DataFrame, order: str, *columns: str, fan_out: int = FAN_OUT) -> DataFrame:
    """number and difference (ADDED, REMOVED, CHANGED) of the rows that two versions of a table
    do not share, by their numbers.  Only blocks that differ are read again row by row."""
    blocks = differing_blocks(fingerprint_tree(old, order, *columns, fan_out=fan_out), fingerprint_tree(new, order, *columns, fan_out=fan_out), fan_out)
    blocks = blocks.select(F.col("node").alias("block"))

    def inside(df: DataFrame, name: str) -> DataFrame:
        rows = _rows(df, order, columns).withColumn("block", F.floor(F.col("node") / fan_out).cast("long"))
        return rows.join(blocks, "block", "left_semi").select(F.col("node").alias("number"), F.col("h").alias(name))

    j = inside(old, "was").join(inside(new, "now"), "number", "full").where(~F.col("was").eqNullSafe(F.col("now")))
    return j.select("number", F.when(F.col("was").isNull(), "ADDED").when(F.col("now").isNull(), "REMOVED").otherwise("CHANGED").alias("difference"))
