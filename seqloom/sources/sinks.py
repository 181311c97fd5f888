"""Writers: fixed columns, write once, staged publishing with markers, resume."""

from __future__ import annotations

import csv
import io
import json
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.hashing import stable_hash
from seqloom.operators.integrity import table_fingerprint
from seqloom.sources.readers import file_digests

MARKER = "_COMPLETE.json"
STAGING, LOCK = ".staging-", ".lock"
BOM = "\ufeff"
#: Rows of a report, and milliseconds after which a lock is left over from a publisher that died.
REPORT_ROWS, STALE_MS = 50_000, 24 * 3600 * 1000


class Exists(FileExistsError):
    """The target is there already and is not overwritten."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None.  Spark's readers pass over names with an underscore."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or for a session on one machine, where that is
    unset, below a local folder; it goes when the driver's JVM ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.gettempdir()
    path = os.path.join(shared, f"{name}-{uuid.uuid4().hex}")
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    return path


def write_csv(df: DataFrame, path: str, columns: Sequence[str], strict: bool = True) -> None:
    """CSV part files with a header and fixed column order, one file with the header alone for
    an empty relation; strict writing refuses other columns."""
    if strict and set(df.columns) != set(columns):
        raise ValueError(f"columns {df.columns}; expected {list(columns)}")
    d = df.select(*columns)
    if d.isEmpty():
        d = df.sparkSession.createDataFrame([], d.schema).repartition(1)
    d.write.mode("errorifexists").option("header", True).csv(path)


def write_report(df: DataFrame, path: str, columns: Sequence[str], most: int = REPORT_ROWS) -> None:
    """A report for people as one CSV file, with a byte-order mark and a header, also without
    rows; written once.  Rows pass the driver, so more than ``most`` are refused before any
    does; ``write_csv`` has no such bound."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a report has {most} rows at most")
    out = io.StringIO()
    sheet = csv.writer(out, lineterminator="\n")
    sheet.writerow(columns)
    for r in df.select(*columns).toLocalIterator():
        sheet.writerow(["" if v is None else v for v in r])
    if exists(df.sparkSession, path):
        raise Exists(path)
    write_text(df.sparkSession, path, BOM + out.getvalue())


def write_once(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _move(spark: SparkSession, staging: str, path: str) -> None:
    """Rename a staging folder to its target.  A lock file, created exclusively, keeps other
    publishers out meanwhile, and a target that is there already is left alone.  The lock is
    held for one rename: one older than ``STALE_MS`` was left by a publisher that died and is
    taken away.  ``seqloom.sources.commits`` does without locks."""
    fs, tmp = _fs(spark, staging)
    _, target = _fs(spark, path)
    _, lock = _fs(spark, path + LOCK)
    try:
        if fs.exists(lock) and fs.getFileStatus(lock).getModificationTime() < time.time() * 1000 - STALE_MS:
            fs.delete(lock, False)
        fs.create(lock, False).close()
    except Exception as e:
        raise Exists(f"{path} is being published ({LOCK} is there)") from e
    try:
        if fs.exists(target) or not fs.rename(tmp, target):
            raise Exists(path)
        # Some stores move a folder into one that came into being meanwhile.
        _, inside = _fs(spark, os.path.join(path, os.path.basename(staging)))
        if fs.exists(inside):
            fs.delete(inside, True)
            raise Exists(path)
    finally:
        fs.delete(lock, False)


def publish(df: DataFrame, path: str, policy: object, source_hash: str, validate: Callable[[DataFrame], None] | None = None, partition_by: Sequence[str] = (), file_hashes: bool = False) -> dict:
    """Write to a staging folder, validate what was written, add a marker, then rename.

    Readers see the whole bundle or none.  An existing target is never overwritten.  With
    ``file_hashes`` the marker names each file with its SHA-256 (files of 2 GB at most).
    """
    return publish_set({"": df}, path, policy, source_hash, validate and (lambda t: validate(t[""])), partition_by, file_hashes)


def publish_set(tables: Mapping[str, DataFrame], path: str, policy: object, source_hash: str, validate: Callable[[dict[str, DataFrame]], None] | None = None, partition_by: Sequence[str] = (), file_hashes: bool = False) -> dict:
    """As ``publish`` for several named tables, each a folder of the bundle; the marker lists
    them, and ``bundle_status`` wants exactly those."""
    spark = next(iter(tables.values())).sparkSession
    if exists(spark, path):
        raise Exists(path)
    staging = f"{path}{STAGING}{uuid.uuid4().hex}"
    fs, tmp = _fs(spark, staging)
    try:
        for name, df in tables.items():
            write_once(df, os.path.join(staging, name) if name else staging, partition_by)
        written = {name: spark.read.parquet(os.path.join(staging, name) if name else staging) for name in tables}
        if validate:
            validate(written)
        marker = {
            "policy_hash": stable_hash(policy), "source_hash": source_hash, "tables": sorted(tables), "partition_by": list(partition_by),
            "content": {n: _content(d) for n, d in written.items()}, "rows": sum(d.count() for d in written.values()),
        }
        if file_hashes:
            marker["files"] = {r["path"].rsplit(os.path.basename(staging) + "/", 1)[1]: r["sha256"] for r in file_digests(spark, staging).collect() if "/_" not in r["path"]}
        write_text(spark, f"{staging}/{MARKER}", json.dumps(marker, sort_keys=True))
        _move(spark, staging, path)
        return marker
    except BaseException:
        fs.delete(tmp, True)
        raise


def _content(d: DataFrame) -> str:
    return table_fingerprint(d.select(*sorted(d.columns)))


def bundle_status(spark: SparkSession, path: str, policy: object, source_hash: str) -> str:
    """PROCESS if nothing is there, SKIP if the same bundle is and its tables and content still
    fit its marker, else which conflict."""
    if not exists(spark, path):
        return "PROCESS"
    text = read_text(spark, f"{path}/{MARKER}")
    if text is None:
        return "CONFLICT_INCOMPLETE"
    marker = json.loads(text)
    if marker["policy_hash"] != stable_hash(policy) or marker["source_hash"] != source_hash:
        return "CONFLICT_PROVENANCE"
    fs, p = _fs(spark, path)
    folders = {s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()}
    named = set(marker["tables"]) - {""}
    if (named or not marker["partition_by"]) and folders != named:
        return "CONFLICT_INVALID_BUNDLE"
    try:
        same = all(_content(spark.read.parquet(os.path.join(path, n) if n else path)) == h for n, h in marker["content"].items())
        if same and "files" in marker:
            there = {r["path"].rsplit(os.path.basename(path) + "/", 1)[1]: r["sha256"] for r in file_digests(spark, path).collect() if "/_" not in r["path"]}
            same = there == marker["files"]
    except AnalysisException:
        same = False
    return "SKIP" if same else "CONFLICT_INVALID_BUNDLE"


def finished(statuses: DataFrame, summary: dict, status: str = "status") -> dict | None:
    """The stored summary if every planned item may be skipped, else None: there is work."""
    left = statuses.where(F.coalesce(F.col(status) != "SKIP", F.lit(True))).isEmpty()
    return {**summary, "resumed": True} if left else None


def bundles(spark: SparkSession, root: str) -> list[str]:
    """Paths of the published bundles below a folder: those that hold a marker.  Staging folders
    and folders without one are passed over.  One path a bundle goes through the driver."""
    fs, p = _fs(spark, root)
    found, left = [], [p]
    while left:
        at = left.pop()
        inside = fs.listStatus(at)
        if any(s.getPath().getName() == MARKER for s in inside):
            found.append(at.toString())
        else:
            left += [s.getPath() for s in inside if s.isDirectory() and STAGING not in s.getPath().getName()]
    return sorted(found)


def bundle_ids(spark: SparkSession, root: str) -> DataFrame:
    """id: the names of the published bundles' folders."""
    return spark.createDataFrame([(b.rstrip("/").rsplit("/", 1)[1],) for b in bundles(spark, root)], "id string")


def global_manifest(spark: SparkSession, root: str, key: str, table: str = "") -> tuple[DataFrame, DataFrame]:
    """All rows of the published bundles below a folder (of one of their tables, if named), with
    their partition columns, and keys that stand more than once."""
    paths = bundles(spark, root)
    if not paths:
        raise FileNotFoundError(f"no published bundle below {root}")
    at = [os.path.join(b, table) if table else b for b in paths]
    split = [bool(json.loads(read_text(spark, f"{b}/{MARKER}"))["partition_by"]) for b in paths]
    # Bundles without partition columns are one scan; the others have a base folder each.
    parts = [spark.read.option("basePath", p).parquet(p) for p, s in zip(at, split, strict=True) if s]
    plain = [p for p, s in zip(at, split, strict=True) if not s]
    parts = ([spark.read.parquet(*plain)] if plain else []) + parts
    whole = parts[0]
    for d in parts[1:]:
        whole = whole.unionByName(d)
    return whole, whole.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unchanged(old: DataFrame, new: DataFrame) -> bool:
    """Whether two relations have the same columns, types and rows, as often."""
    types = lambda d: sorted((f.name, f.dataType.simpleString()) for f in d.schema)
    return types(old) == types(new) and _content(old) == _content(new)
