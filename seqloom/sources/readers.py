"""Scans: typed CSV and Parquet, profiling, file inventories, packed sequences."""

from __future__ import annotations

import csv
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.functions.scalars import normal_reference
from seqloom.operators.integrity import seal
from seqloom.operators.ordering import numbered

#: Preferred column names of each role, best first.
ROLES = {
    "video_id": ("video_id", "source_video", "filename", "file_name"),
    "label": ("label", "class", "target", "status"),
    "source_path": ("video_path", "source_path", "path", "filepath", "file_path"),
}
#: What else a column's normal name may hold to fill a role.
HINTS = {
    "video_id": lambda n: ("video" in n and "id" in n) or "filename" in n or n.endswith("file_name"),
    "label": lambda n: any(t in n for t in ("label", "class", "target")),
    "source_path": lambda n: any(t in n for t in ("path", "source", "filename")),
}


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def typed_csv(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """A CSV with a header, read with a declared schema.  A byte-order mark before the first
    name is dropped; strict reading fails on rows that don't fit."""
    header = spark.read.option("header", True).csv(path).columns
    names = [c.lstrip("﻿") for c in header]
    if strict and names != schema.names:
        raise ValueError(f"columns {names}; expected {schema.names}")
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    raw = spark.read.schema(text).option("header", True).option("enforceSchema", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path)
    cast = lambda f: (F.col(f"`{f.name}`").cast(f.dataType) if strict else F.col(f"`{f.name}`").try_cast(f.dataType)).alias(f.name)
    return raw.select(*[cast(f) for f in schema.fields if f.name in names])


def split_rows(df: DataFrame, expected: str) -> DataFrame:
    """Rows whose split, blank or missing ones filled in, must be ``expected``."""
    split = F.coalesce(F.nullif(F.col("split"), F.lit("")), F.lit(expected)) if "split" in df.columns else F.lit(expected)
    d = df.withColumn("split", split)
    wrong = d.where(F.col("split") != expected).limit(1).collect()
    if wrong:
        raise ValueError(f"a row of split {wrong[0]['split']} among {expected}")
    return d


def sealed_table(spark: SparkSession, directory: str, name: str, split: str, forbidden: Sequence[str]) -> DataFrame:
    return seal(table(spark, directory, name), split, forbidden)


def role_candidates(columns: Sequence[str]) -> dict[str, list[str]]:
    """For each role the columns that may fill it: preferred names by preference, then hints."""
    normal = {c: re.sub(r"\s+", "_", c.strip().lower().replace("-", "_")) for c in columns}
    rank = lambda role, c: ROLES[role].index(normal[c]) if normal[c] in ROLES[role] else len(ROLES[role])
    fits = lambda role: [c for c in columns if normal[c] in ROLES[role] or HINTS[role](normal[c])]
    return {role: sorted(fits(role), key=lambda c: rank(role, c)) for role in ROLES}


class BadTable(ValueError):
    """A text table whose header or rows can't be read."""


def strict_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV as trimmed text columns.  A missing header, an empty or repeated name, and rows with
    more values than names are refused; short rows are filled up with blanks."""
    lines = spark.read.option("wholetext", False).text(path)
    if lines.isEmpty():
        raise BadTable(f"{path}: no header")
    names = next(csv.reader([lines.first()[0].lstrip("\ufeff")]), [])
    names = [n.strip() for n in names]
    if not names or not all(names):
        raise BadTable(f"{path}: an empty column name")
    if len(set(names)) != len(names):
        raise BadTable(f"{path}: a column name is there twice")
    # One more column than there are names takes what is too much.
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names) + 1)])
    rows = spark.read.schema(wide).option("header", True).option("enforceSchema", True).option("multiLine", True).csv(path)
    if not rows.where(F.col(f"c{len(names)}").isNotNull()).isEmpty():
        raise BadTable(f"{path}: a row has more values than the header")
    return rows.select(*[F.trim(F.coalesce(f"c{i}", F.lit(""))).alias(n) for i, n in enumerate(names)])


def metadata_tables(spark: SparkSession, directory: str, names: Sequence[str]) -> tuple[dict[str, DataFrame], list[str]]:
    """The named CSV files of a folder that are there, and what is wrong with those that can't
    be read: an error in one keeps no other from being read."""
    read, errors = {}, []
    for name in names:
        path = f"{directory}/{name}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            continue
        try:
            read[name] = strict_csv(spark, path)
        except (BadTable, AnalysisException) as e:
            errors.append(f"{name}: {e}")
    return read, errors


def profile(df: DataFrame) -> DataFrame:
    """column, n_rows, n_blank (null or white space), n_distinct: one pass for all columns."""
    text = {c: F.trim(F.col(f"`{c}`").cast("string")) for c in df.columns}
    aggs = [F.struct(F.lit(c).alias("column"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(t, F.lit("")) == "").alias("n_blank"), F.count_distinct(t).alias("n_distinct")) for c, t in text.items()]
    return df.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """n_rows and n_duplicates, rows that repeat an earlier one."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def _below(root: str) -> Column:
    """The column path as one below a folder."""
    return F.regexp_replace(F.col("path"), f"^(file:)?/*{re.escape(root.strip('/'))}/", "")


def file_inventory(spark: SparkSession, path: str, extensions: Sequence[str], whole_tables: bool = False) -> DataFrame:
    """Files below a folder with one of the extensions, without their content: path, length,
    name, stem, extension.  With ``whole_tables`` a folder with one of the extensions, such as a
    table of many part files, counts as one file: their length together, their latest change."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    if whole_tables:
        ends = "|".join(re.escape(e) for e in extensions)
        inside = F.regexp_extract(_below(path), rf"(?i)^(?:[^/]+/)*?[^/]*(?:{ends})(/.*)$", 1)
        d = d.withColumn("path", F.col("path").substr(F.lit(1), F.length("path") - F.length(inside)))
        d = d.groupBy("path").agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"))
    name = F.regexp_extract("path", r"[^/]+$", 0)
    d = d.withColumns({"name": name, "extension": F.lower(F.regexp_extract(name, r"\.[^.]*$", 0)), "stem": F.regexp_replace(name, r"\.[^.]*$", "")})
    return d.where(F.col("extension").isin([e.lower() for e in extensions]))


def lookup_keys(files: DataFrame, project: str, raw: str) -> DataFrame:
    """path and key: four names under which a file of ``file_inventory`` is found, its path below
    the project's folder, below the raw folder, its name and its stem, all in normal form."""
    below = lambda root: normal_reference(_below(root))
    keys = F.array(F.concat(F.lit("project:"), below(project)), F.concat(F.lit("raw:"), below(raw)), F.concat(F.lit("name:"), F.lower("name")), F.concat(F.lit("stem:"), F.lower("stem")))
    return files.select("path", F.explode(keys).alias("key"))


def source_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path and fingerprint (SHA-256 of path, size and time of change), without reading files.
    Spark passes over empty files."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return d.select("path", F.sha2(F.concat_ws("|", "path", "length", F.unix_micros("modificationTime")), 256).alias("fingerprint"))


def scan_order(scan: DataFrame) -> DataFrame:
    """A scan of Parquet files with the file (scan_file) and the place in it (scan_row) of each
    row, which the reader knows; to be taken before anything else is done to the scan."""
    return scan.select("*", F.col("_metadata.file_path").alias("scan_file"), F.col("_metadata.row_index").alias("scan_row"))


def ordered_mapping(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows in manifest order, with a dense ``position``; a place that is there twice is an error."""
    twice = df.groupBy(*order).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"place {tuple(twice[0])[:-1]} is there more than once")
    return numbered(df, [], list(order), "position").drop("total")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, length, sha256 of every file below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def packed(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Long slots as one array a column and key, in slot order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), *[F.col(v) for v in values])))
    d = df.groupBy(*keys).agg(rows.alias("__r"))
    pick = lambda v: F.transform("__r", lambda s: s[v]).alias(v)
    return d.select(*keys, *[pick(v) for v in values])


def batches(df: DataFrame, index: str, size: int, seed: int | None = None) -> DataFrame:
    """batch and position for rows with a dense index; with a seed, in a seeded order, which is
    made by ranking within hash buckets and adding up the buckets."""
    if seed is None:
        place = F.col(index)
        return df.withColumns({"batch": F.floor(place / size).cast("long"), "position": F.pmod(place, F.lit(size)).cast("long")})
    from pyspark.sql import Window

    h = F.xxhash64(F.lit(seed), F.col(index))
    d = df.withColumn("__h", h).withColumn("__b", F.pmod("__h", F.lit(1024)).cast("int"))
    counts = d.groupBy("__b").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("__b", (F.sum("n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    rn = F.row_number().over(Window.partitionBy("__b").orderBy("__h", index)) - 1
    d = d.join(before, "__b").withColumn("__p", F.col("before") + rn)
    return d.withColumns({"batch": F.floor(F.col("__p") / size).cast("long"), "position": F.pmod("__p", F.lit(size)).cast("long")}).drop("__h", "__b", "__p", "before")
