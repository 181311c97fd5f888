"""Checked joins, prioritised lookups, reconciliation, dictionary encoding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered


class Unmatched(ValueError):
    """A checked join met keys without a match, or twice."""


def require_unique(df: DataFrame, keys: Sequence[str], name: str = "table") -> DataFrame:
    twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise Unmatched(f"{name}: keys met more than once, such as {[tuple(r)[:-1] for r in twice]}")
    return df


def checked_join(left: DataFrame, *rights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-joins in which every left row must find exactly one row of each side."""
    out = left
    for i, r in enumerate(rights):
        require_unique(r, keys, f"side {i + 1}")
        missing = left.join(r, list(keys), "left_anti").limit(3).collect()
        if missing:
            raise Unmatched(f"side {i + 1}: no match for {missing}")
        out = out.join(r, list(keys))
    return out


def prioritized_lookup(left: DataFrame, left_id: str, candidates: Sequence[tuple[int, str, DataFrame, str, str]]) -> DataFrame:
    """left_id, right_id, priority of the best key that finds exactly one row.

    ``candidates`` are (priority, left column, right table, right column, right id); lower
    priorities come first, and a key with several matches is passed over.  Right tables are
    brought down to one row a key first, so matches of a common key are never written out.
    """
    found = None
    for priority, column, right, on, rid in candidates:
        held = right.groupBy(F.col(on).alias("__k")).agg(F.min(rid).alias("low"), F.max(rid).alias("high"))
        hits = left.select(F.col(left_id).alias("left_id"), F.col(column).alias("__k")).join(held, "__k")
        one = hits.groupBy("left_id").agg(F.min("low").alias("right_id"), F.max("high").alias("high")).where("right_id = high")
        one = one.select("left_id", "right_id", F.lit(priority).alias("priority"))
        found = one if found is None else found.unionByName(one)
    return found.groupBy("left_id").agg(F.min_by("right_id", "priority").alias("right_id"), F.min("priority").alias("priority"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], names: tuple[str, str, str, str] = ("BOTH", "LEFT_ONLY", "RIGHT_ONLY", "NEITHER"), universe: DataFrame | None = None) -> DataFrame:
    """keys and status; with a universe, its keys that stand on no side are NEITHER."""
    a, b = left.select(*keys).distinct().withColumn("__l", F.lit(True)), right.select(*keys).distinct().withColumn("__r", F.lit(True))
    j = a.join(b, list(keys), "full")
    if universe is not None:
        j = universe.select(*keys).distinct().join(j, list(keys), "full")
    l, r = F.coalesce("__l", F.lit(False)), F.coalesce("__r", F.lit(False))
    both, only_l, only_r, neither = names
    return j.select(*keys, F.when(l & r, both).when(l, only_l).when(r, only_r).otherwise(neither).alias("status"))


def dictionary_encode(df: DataFrame, column: str, out: str = "code") -> tuple[DataFrame, DataFrame]:
    """The rows with a dense code for ``column`` in ascending order, and the dictionary.

    Codes number the distinct values range by range (``ordering.numbered``), so there is no
    window over all of them, and they are the same whenever they are computed.
    """
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    codes = numbered(distinct, [], [column], out).select(column, out)
    return df.join(codes, column, "left"), codes


def gather(codes: DataFrame, sources: DataFrame, code: str, keys: Sequence[str], order: str, value: str, out: str) -> DataFrame:
    """Per key the values of its sources as one array in slot order (a key has few slots)."""
    j = codes.join(sources, code)
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return j.groupBy(*keys).agg(F.transform(packed, lambda s: s["v"]).alias(out))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many rows (with multiplicity) only one side has: only_left, only_right, equal."""
    left = a.exceptAll(b).agg(F.count(F.lit(1)).alias("only_left"))
    right = b.exceptAll(a).agg(F.count(F.lit(1)).alias("only_right"))
    return left.join(right).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def same_sequence(a: DataFrame, b: DataFrame, position: str) -> DataFrame:
    """Whether two relations hold the same rows in the same order, which a dense position in
    each gives: positions, differing (places where they differ or one has none), equal."""
    row = lambda d, name: d.select(F.col(position).alias("at"), F.struct(*[c for c in d.columns if c != position]).alias(name))
    j = row(a, "left_row").join(row(b, "right_row"), "at", "full")
    out = j.agg(F.count(F.lit(1)).alias("positions"), F.count_if(~F.col("left_row").eqNullSafe(F.col("right_row"))).alias("differing"))
    return out.withColumn("equal", F.col("differing") == 0)


def pivot_complete(df: DataFrame, key: str, by: str, values: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each key with ``column_value`` columns; complete says whether all are there."""
    aggs = [F.first(F.when(F.col(by) == v, F.col(c)), ignorenulls=True).alias(f"{c}_{v}") for v in values for c in columns]
    return df.groupBy(key).agg(*aggs, (F.count_distinct(F.when(F.col(by).isin(list(values)), F.col(by))) == len(values)).alias("complete"))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", rn).where("__rn = 1").drop("__rn")


def version_differences(a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys that two versions of a table don't agree on, and which columns differ ('absent': the
    key stands on one side only)."""
    left = a.select(*keys, F.struct(*columns).alias("left_row"))
    right = b.select(*keys, F.struct(*columns).alias("right_row"))
    j = left.join(right, list(keys), "full")
    both = F.col("left_row").isNotNull() & F.col("right_row").isNotNull()
    found = [F.when(~both, "absent"), *[F.when(both & ~F.col(f"left_row.{c}").eqNullSafe(F.col(f"right_row.{c}")), c) for c in columns]]
    return j.select(*keys, F.array_join(F.array_compact(F.array(*found)), ",").alias("differs")).where("differs <> ''")


def count_differences(stored: DataFrame, own: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """key, name, stored, own for each stored count that isn't the computed one."""
    s = stored.select(key, *[F.col(n).alias(f"stored_{n}") for n in names])
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"stored_{n}").cast("long").alias("stored"), F.col(n).cast("long").alias("own")) for n in names])
    j = own.join(s, key, "full").select(key, F.explode(cells).alias("c")).select(key, "c.*")
    return j.where(~F.col("stored").eqNullSafe(F.col("own")))


def reconcile_branches(canonical: DataFrame, frozen: DataFrame, context: DataFrame, behavior: DataFrame, key: str) -> DataFrame:
    """Four universes side by side: key, status of the two branches, whether the plan has it, and
    whether a branch has what the plan doesn't.  Keys outside the canonical ones are kept."""
    sides = {"canonical": canonical, "frozen": frozen, "context": context, "behavior": behavior}
    rows = None
    for name, side in sides.items():
        d = side.select(key, F.lit(name).alias("side"))
        rows = d if rows is None else rows.unionByName(d)
    has = {n: F.max((F.col("side") == n).cast("int")) == 1 for n in sides}
    g = rows.groupBy(key).agg(*[has[n].alias(n) for n in sides])
    status = F.when(F.col("context") & F.col("behavior"), "BOTH").when(F.col("context"), "CONTEXT_ONLY").when(F.col("behavior"), "BEHAVIOR_ONLY").otherwise("NEITHER")
    return g.select(key, status.alias("status"), "frozen", ((F.col("context") | F.col("behavior")) & ~F.col("frozen")).alias("unplanned"))


def plan_parts(frozen: DataFrame, made: DataFrame, key: str) -> DataFrame:
    """Each key of a frozen plan or of what was made: PLANNED (both), EXCLUDED (only frozen),
    UNKNOWN (only made)."""
    return reconcile(frozen, made, [key], ("PLANNED", "EXCLUDED", "UNKNOWN", "")).withColumnRenamed("status", "part")


def labelled(left: DataFrame, metadata: DataFrame, key: str, label: str, path: str, folder: str) -> DataFrame:
    """The left rows with state: NO_METADATA, LABEL (they disagree), PATH (outside the folder), OK."""
    m = metadata.select(key, F.col(label).alias("metadata_label"), F.lit(True).alias("has_metadata"))
    outside = ~F.col(path).startswith(folder) | F.col(path).rlike(r"(^|/)\.\.(/|$)")
    state = F.when(F.col("has_metadata").isNull(), "NO_METADATA").when(~F.col(label).eqNullSafe(F.col("metadata_label")), "LABEL").when(outside, "PATH").otherwise("OK")
    return left.join(m, key, "left").withColumn("state", state).drop("metadata_label", "has_metadata")


def gather_audit(targets: DataFrame, sources: DataFrame, key: str, value: str) -> DataFrame:
    """name and value: targets, those without a source, those that differ from the source they
    name, and sources that no target names."""
    j = targets.select(key, F.col(value).alias("target_value")).join(sources.select(key, F.col(value).alias("source_value"), F.lit(True).alias("there")), key, "left")
    a = j.agg(F.count(F.lit(1)).alias("targets"), F.count_if(F.col("there").isNull()).alias("without_source"), F.count_if(F.col("there").isNotNull() & ~F.col("target_value").eqNullSafe(F.col("source_value"))).alias("differing"))
    unused = sources.join(targets.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("unused_sources"))
    return a.join(unused).unpivot([], ["targets", "without_source", "differing", "unused_sources"], "name", "value")
