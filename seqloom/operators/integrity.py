"""Constraints as data: violations, fingerprints, resume states, decisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.hashing import bag_hash


class Sealed(ValueError):
    """Rows of a split that must not be read were found."""


def seal(df: DataFrame, split: str, forbidden: Sequence[str]) -> DataFrame:
    """``df``, after a check that no row belongs to a forbidden split."""
    if not df.where(F.col(split).isin(list(forbidden))).isEmpty():
        raise Sealed(f"rows of {list(forbidden)} in column {split}")
    return df


def violations(df: DataFrame, keys: Sequence[str], rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row for each key and rule that it breaks; conditions state the fault, null is none."""
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules]))
    return df.select(*keys, F.explode(broken).alias("rule"))


def violation_counts(df: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """rule and how many rows break it, zeros included, in one pass."""
    pairs = F.array(*[F.struct(F.lit(code).alias("rule"), F.count_if(F.coalesce(c, F.lit(False))).alias("n")) for code, c in rules])
    return df.agg(pairs.alias("a")).select(F.explode("a").alias("x")).select("x.rule", "x.n")


def dense_order(df: DataFrame, index: str) -> DataFrame:
    """Faults of an index that should be 0..n-1: n, low, high, distinct, dense."""
    a = df.agg(F.count(F.lit(1)).alias("n"), F.min(index).alias("low"), F.max(index).alias("high"), F.count_distinct(index).alias("distinct"))
    return a.withColumn("dense", (F.col("low") == 0) & (F.col("high") == F.col("n") - 1) & (F.col("distinct") == F.col("n")))


def scattered_groups(rows: DataFrame, key: str, file: str = "scan_file", place: str = "scan_row") -> DataFrame:
    """key and fault of groups whose rows do not stand together in the order they were read:
    IN_FILE, other rows stand between them in a file; ACROSS_FILES, they are in several files
    that are not neighbours by name, or do not run on from a file's end to the next one's start.

    A group stands together in a file if its last place is as far from its first as it has
    rows, so counts and bounds of each file and group decide, and no file is read in order.
    """
    pieces = rows.groupBy(file, key).agg(F.min(place).alias("low"), F.max(place).alias("high"), F.count(F.lit(1)).alias("n"))
    apart = F.max(F.col("high") - F.col("low") + 1 != F.col("n")).alias("apart")
    # One row a file.
    files = pieces.groupBy(file).agg(F.min("low").alias("start"), F.max("high").alias("end"))
    files = files.withColumn("number", F.row_number().over(Window.orderBy(file)))
    several = pieces.groupBy(key).agg(apart, F.count(F.lit(1)).alias("files"))
    on = Window.partitionBy(key).orderBy("number")
    parts = pieces.join(several.where("files > 1").select(key), key, "left_semi").join(files, file)
    last = lambda c: F.lag(c).over(on)
    broken = F.col("before").isNotNull() & ((F.col("number") != F.col("before") + 1) | ~F.col("to_end") | (F.col("low") != F.col("start")))
    parts = parts.withColumns({"before": last("number"), "to_end": last(F.col("high") == F.col("end"))})
    across = parts.groupBy(key).agg(F.max(broken).alias("across")).where("across").select(key, F.lit("ACROSS_FILES").alias("fault"))
    return several.where("apart").select(key, F.lit("IN_FILE").alias("fault")).unionByName(across)


def table_fingerprint(df: DataFrame) -> str:
    """A content hash of a table that does not depend on the order of its rows."""
    return df.agg(bag_hash(*df.columns).alias("h")).first()["h"]


def reconcile_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """(name, value) tables side by side: name, left, right, equal."""
    j = a.withColumnRenamed("value", "left").join(b.withColumnRenamed("value", "right"), "name", "full")
    return j.select("name", "left", "right", F.col("left").eqNullSafe(F.col("right")).alias("equal"))


def resume_status(plan: DataFrame, markers: DataFrame, key: str) -> DataFrame:
    """What to do with each planned item (key, policy_hash, source_hash) given the markers of
    what exists (key, policy_hash, source_hash, valid): PROCESS, SKIP, or a conflict."""
    m = markers.select(key, F.col("policy_hash").alias("__p"), F.col("source_hash").alias("__s"), "valid", F.lit(True).alias("__there"))
    j = plan.join(m, key, "left")
    status = (
        F.when(F.col("__there").isNull(), "PROCESS")
        .when(F.col("valid").isNull(), "CONFLICT_INCOMPLETE")
        .when(~F.col("__p").eqNullSafe(F.col("policy_hash")) | ~F.col("__s").eqNullSafe(F.col("source_hash")), "CONFLICT_PROVENANCE")
        .when(~F.col("valid"), "CONFLICT_INVALID_BUNDLE")
        .otherwise("SKIP")
    )
    return j.select(key, status.alias("status"))


def explained(mismatches: DataFrame, allowed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the mismatches are exactly the allowed ones: unexplained, absent, exact."""
    extra = mismatches.join(allowed, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("unexplained"))
    absent = allowed.join(mismatches, list(keys), "left_anti").agg(F.count(F.lit(1)).alias("absent"))
    return extra.join(absent).withColumn("exact", (F.col("unexplained") == 0) & (F.col("absent") == 0))


def decision(failed: Column, warned: Column) -> Column:
    """FAILED before WARNINGS before READY."""
    return F.when(failed > 0, "FAILED").when(warned > 0, "WARNINGS").otherwise("READY")


def artifact_differences(recorded: DataFrame, there: DataFrame, name: str, digest: str) -> DataFrame:
    """name and difference: ABSENT or NOT_RECORDED files, and files of another HASH."""
    a = recorded.select(name, F.col(digest).alias("recorded_digest"), F.lit(True).alias("is_recorded"))
    b = there.select(name, F.col(digest).alias("own_digest"), F.lit(True).alias("is_there"))
    kind = F.when(F.col("is_recorded").isNull(), "NOT_RECORDED").when(F.col("is_there").isNull(), "ABSENT").when(~F.col("recorded_digest").eqNullSafe(F.col("own_digest")), "HASH")
    return a.join(b, name, "full").select(name, kind.alias("difference")).where("difference IS NOT NULL")


def anomaly_total(counters: DataFrame, ignored: Sequence[str] = ()) -> DataFrame:
    """From (name, value) counters: anomalies (the sum but for ignored names) and PASS or REVIEW."""
    total = F.coalesce(F.sum(F.when(~F.col("name").isin(list(ignored)), F.col("value"))), F.lit(0))
    return counters.agg(total.cast("long").alias("anomalies"), F.when(total == 0, "PASS").otherwise("REVIEW").alias("decision"))


def source_index_audit(rows: DataFrame, key: str, path: str, expected: int, sealed: str) -> DataFrame:
    """Faults of a list of sources whose ids should be 0..expected-1 in order: one row of counts.
    The order holds if no id differs from the number of ids below it."""
    from .ordering import numbered

    d = numbered(rows.select(key, path), [], [key, path], "position")
    n = F.count(F.lit(1))
    return d.agg(
        n.alias("rows_found"), (n != expected).cast("int").alias("row_count_mismatch"), (n - F.count_distinct(key)).alias("duplicate_source_ids"), F.count_if((F.col(key) < 0) | (F.col(key) >= expected)).alias("invalid_source_ids"),
        (F.count_if(F.col(key) != F.col("position")) > 0).cast("int").alias("source_id_order_mismatch"), (n - F.count_distinct(path)).alias("duplicate_source_paths"), F.count_if(F.array_contains(F.split(path, "/"), sealed)).alias("test_source_references"),
    )
