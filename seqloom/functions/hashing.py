"""Hashes that tell whether content changed."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows that are hashed together in ``ordered_hash``.
BLOCK = 4096


def stable_hash(value: object) -> str:
    """SHA-256 of a JSON value with sorted keys, without spaces, characters unescaped."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def row_hash(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON text, names in order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def relation_hash(order: Column, *columns: str) -> Column:
    """An aggregate: the order-sensitive hash of a group's rows.  For small groups only; a
    group's row hashes (64 characters each) meet in one row."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), row_hash(*columns).alias("h"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: r["h"]), "\n"), 256)


def flagged(*columns: str) -> list[Column]:
    """The columns as JSON text of one field each, which tells nulls, also nested ones, from
    one another and from empty values."""
    return [F.to_json(F.struct(F.col(f"`{c}`").alias("v")), {"ignoreNullFields": "false"}) for c in columns]


def bag_hash(*columns: str) -> Column:
    """An aggregate: a hash of any number of rows that does not depend on their order.  Two
    64-bit hashes a row are summed up and combined bit by bit."""
    values = flagged(*columns)
    one, two = F.xxhash64(*values), F.xxhash64(F.lit("second"), *reversed(values))
    parts = [x for h in (one, two) for x in (F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)), F.coalesce(F.bit_xor(h), F.lit(0)))]
    return F.concat_ws("-", F.count(F.lit(1)), *parts)


def joined_hashes(order: str, h: str) -> Column:
    """An aggregate: the hash of a group's numbered hashes in their order; for bounded groups."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(h).alias("h"))))
    return F.sha2(F.array_join(F.transform(rows, lambda r: F.concat(r["o"].cast("string"), F.lit(":"), r["h"])), "\n"), 256)


def ordered_hash(df: DataFrame, order: str, *columns: str, fan_out: int = BLOCK) -> DataFrame:
    """h and n: a hash of a relation of any size in the order of a dense number from 0.

    Rows are hashed with their numbers in blocks of ``fan_out`` neighbours, the blocks' hashes
    likewise, and so on, until as many levels (two at least) as the largest number needs are
    one hash: no task holds more than ``fan_out`` of them.
    """
    top = df.agg(F.max(F.col(order).cast("long"))).first()[0] or 0
    levels = 2
    while fan_out**levels <= top:
        levels += 1
    rows = df.select(F.col(order).cast("long").alias("o"), F.sha2(F.concat_ws("\n", *flagged(*columns)), 256).alias("h"), F.lit(1).cast("long").alias("n"))
    for _ in range(levels - 1):
        rows = rows.groupBy(F.floor(F.col("o") / fan_out).cast("long").alias("b")).agg(joined_hashes("o", "h").alias("h"), F.sum("n").alias("n")).withColumnRenamed("b", "o")
    return rows.agg(joined_hashes("o", "h").alias("h"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
