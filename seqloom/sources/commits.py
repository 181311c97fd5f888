"""Published bundles as an append-only log of commits, for any number of bundles.

    root/data/attempt_id=A/bundle_id=B/   what one publisher wrote, many bundles at once
    root/manifests/A/                     its bundles: rows and content, a small table
    root/log/00000003/<version>.json      the commit that makes attempt A count
    root/log/00000003/<version>.snapshot  where the table of all bundles up to there stands

A commit is one file, created whole or not at all; whoever creates the next version's file has
won, the others look again and take the one after.  There is no lock, so a publisher that dies
holds up no one: what it wrote is in no commit and no reader sees it.  Bundles are read as one
table, joined with one scan of the data; the driver handles names of the commits since the last
snapshot, never single bundles.  A reader may ask for the state of any version.

Creating a file whole needs a store whose rename does not replace (HDFS) or a local disk (hard
links); on other stores a commit service has to stand in for ``_put``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from seqloom.functions.hashing import bag_hash, stable_hash
from seqloom.sources.sinks import Exists, _fs, exists, read_text, write_text

#: Commits of one folder of the log, and commits from one snapshot to the next.
FOLDER, SNAPSHOT_EVERY = 1000, 100
BUNDLE, ATTEMPT = "bundle_id", "attempt_id"
_TABLE = f"{BUNDLE} string, {ATTEMPT} string, rows long, content string, policy_hash string, source_hash string, version long"


def _entry(root: str, version: int, kind: str) -> str:
    return f"{root}/log/{version // FOLDER:08d}/{version:020d}.{kind}"


def _put(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole content; False if it is there already."""
    fs, target = _fs(spark, path)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    _, source = _fs(spark, draft)
    write_text(spark, draft, text)
    try:
        if fs.getUri().getScheme() == "file":  # a local rename would replace the target
            os.link(source.toUri().getPath(), target.toUri().getPath())
            return True
        return bool(fs.rename(source, target))
    except FileExistsError:
        return False
    except Exception:
        if fs.exists(target):
            return False
        raise
    finally:
        fs.delete(source, False)


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _versions(spark: SparkSession, root: str, folder: str, kind: str) -> list[int]:
    return [int(n.split(".")[0]) for n in _names(spark, f"{root}/log/{folder}") if n.endswith(f".{kind}") and n.count(".") == 1]


def latest(spark: SparkSession, root: str) -> int:
    """The newest version, -1 before the first commit."""
    for folder in reversed(_names(spark, f"{root}/log")):
        if found := _versions(spark, root, folder, "json"):
            return found[-1]
    return -1


def _last_snapshot(spark: SparkSession, root: str, version: int) -> tuple[int, str | None]:
    for folder in range(version // FOLDER, -1, -1):
        found = [v for v in _versions(spark, root, f"{folder:08d}", "snapshot") if v <= version]
        if found:
            return found[-1], read_text(spark, _entry(root, found[-1], "snapshot"))
    return -1, None


def committed(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The bundles that count at a version (the newest): bundle_id, attempt_id, rows, content,
    policy_hash, source_hash and the version that added them."""
    version = latest(spark, root) if version is None else version
    base, at = _last_snapshot(spark, root, version)
    entries = [(v, json.loads(read_text(spark, _entry(root, v, "json")))) for v in range(base + 1, version + 1)]
    old = spark.read.schema(_TABLE).parquet(at) if at else spark.createDataFrame([], _TABLE)
    if not entries:
        return old
    said = spark.createDataFrame([(e["attempt"], e["op"], e["policy_hash"], e["source_hash"], v) for v, e in entries], f"{ATTEMPT} string, op string, policy_hash string, source_hash string, version long")
    made = spark.read.schema(f"{BUNDLE} string, {ATTEMPT} string, rows long, content string").parquet(*[f"{root}/manifests/{e['attempt']}" for _, e in entries])
    # ``said`` has a row for each commit since the last snapshot.
    new = made.join(F.broadcast(said), ATTEMPT)
    both = old.withColumn("op", F.lit("add")).unionByName(new)
    last = both.groupBy(BUNDLE).agg(F.max_by(F.struct(*[c for c in both.columns if c != BUNDLE]), "version").alias("last"))
    return last.where("last.op = 'add'").select(BUNDLE, *[f"last.{c}" for c in (ATTEMPT, "rows", "content", "policy_hash", "source_hash", "version")])


def _schema(spark: SparkSession, root: str) -> StructType | None:
    text = read_text(spark, f"{root}/schema.json")
    return StructType.fromJson(json.loads(text)) if text else None


def _scan(spark: SparkSession, root: str, schema: StructType, path: str = "") -> DataFrame:
    whole = StructType([*schema.fields]).add(ATTEMPT, StringType()).add(BUNDLE, StringType())
    return spark.read.schema(whole).option("basePath", f"{root}/data").parquet(f"{root}/data{path}")


def rows(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All rows of the bundles that count, with bundle_id: one scan, whatever their number."""
    schema = _schema(spark, root)
    if schema is None:
        raise FileNotFoundError(f"no commit below {root}")
    live = committed(spark, root, version).select(ATTEMPT, BUNDLE)
    return _scan(spark, root, schema).join(live, [ATTEMPT, BUNDLE], "left_semi").drop(ATTEMPT)


def repeated(spark: SparkSession, root: str, key: str, version: int | None = None) -> DataFrame:
    """Keys that stand more than once in the bundles that count, and how often."""
    return rows(spark, root, version).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def _commit(spark: SparkSession, root: str, attempt: str, op: str, policy: object, source_hash: str, clash: Callable[[DataFrame], DataFrame]) -> int:
    """Take the next version; ``clash`` gives bundles that forbid it in the state before."""
    entry = json.dumps({"attempt": attempt, "op": op, "policy_hash": stable_hash(policy), "source_hash": source_hash}, sort_keys=True)
    while True:
        version = latest(spark, root)
        found = clash(committed(spark, root, version)).select(BUNDLE).orderBy(BUNDLE).limit(5).collect()
        if found:
            raise Exists(f"bundles {[r[0] for r in found]}")
        if _put(spark, _entry(root, version + 1, "json"), entry):
            break
    if (version + 2) % SNAPSHOT_EVERY == 0:
        snapshot(spark, root, version + 1)
    return version + 1


def snapshot(spark: SparkSession, root: str, version: int) -> None:
    """Write the table of all bundles of a version, from which later reads start."""
    path = f"{root}/snapshots/{version:020d}-{uuid.uuid4().hex}"
    committed(spark, root, version).write.parquet(path)
    _put(spark, _entry(root, version, "snapshot"), path)


def publish(df: DataFrame, root: str, bundle: Column | str, policy: object, source_hash: str = "", validate: Callable[[DataFrame], None] | None = None) -> int:
    """Publish the bundles that ``bundle`` (an expression, or one bundle's id) deals the rows
    into, all in one commit, and return its version.

    What was written is read back for ``validate`` and for the manifest.  A bundle that counts
    already is not replaced: the commit is refused, also when another publisher was faster.
    Rows without a bundle, and another schema than the first commit's, are errors.
    """
    spark = df.sparkSession
    if {BUNDLE, ATTEMPT} & set(df.columns):
        raise ValueError(f"columns {BUNDLE} and {ATTEMPT} are the log's own")
    plain = StructType.fromJson(json.loads(df.schema.json()))
    for f in plain.fields:
        f.nullable = True
    if not exists(spark, f"{root}/schema.json"):
        _put(spark, f"{root}/schema.json", plain.json())
    schema = _schema(spark, root)
    if [(f.name, f.dataType) for f in schema.fields] != [(f.name, f.dataType) for f in plain.fields]:
        raise ValueError(f"schema {plain.simpleString()}; the log has {schema.simpleString()}")
    attempt = uuid.uuid4().hex
    of = F.lit(bundle) if isinstance(bundle, str) else bundle.cast("string")
    dealt = df.withColumn(BUNDLE, F.when(of.isNull() | (of == ""), F.raise_error(F.lit("a row belongs to no bundle"))).otherwise(of))
    # A bundle's rows come together, a large one in several tasks.
    dealt.hint("rebalance", BUNDLE).write.partitionBy(BUNDLE).parquet(f"{root}/data/{ATTEMPT}={attempt}")
    written = _scan(spark, root, schema, f"/{ATTEMPT}={attempt}")
    if validate:
        validate(written.drop(ATTEMPT))
    names = sorted(f.name for f in schema.fields)
    found = written.groupBy(BUNDLE).agg(F.count(F.lit(1)).alias("rows"), F.sha2(bag_hash(*names), 256).alias("content"))
    found.select(BUNDLE, F.lit(attempt).alias(ATTEMPT), "rows", "content").write.parquet(f"{root}/manifests/{attempt}")
    mine = spark.read.parquet(f"{root}/manifests/{attempt}").select(BUNDLE)
    return _commit(spark, root, attempt, "add", policy, source_hash, lambda now: now.join(mine, BUNDLE, "left_semi"))


def retract(spark: SparkSession, root: str, bundles: DataFrame, policy: object = None) -> int:
    """Let the bundles of a table (bundle_id) count no longer; earlier versions still have them."""
    attempt = uuid.uuid4().hex
    bundles.select(F.col(BUNDLE).cast("string").alias(BUNDLE), F.lit(attempt).alias(ATTEMPT), F.lit(0).cast("long").alias("rows"), F.lit("").alias("content")).distinct().write.parquet(f"{root}/manifests/{attempt}")
    mine = spark.read.parquet(f"{root}/manifests/{attempt}").select(BUNDLE)
    return _commit(spark, root, attempt, "remove", policy, "", lambda now: now.limit(0).union(now.limit(0))) if not mine.isEmpty() else latest(spark, root)


def states(spark: SparkSession, root: str, wanted: DataFrame, verify: bool = False) -> DataFrame:
    """For each wanted bundle (bundle_id, policy_hash, source_hash) PROCESS if it is not there,
    SKIP if it is, CONFLICT_PROVENANCE if it came from something else; with ``verify``, which
    reads the data, CONFLICT_INVALID_BUNDLE if its rows are not those that were committed."""
    have = committed(spark, root).select(BUNDLE, ATTEMPT, "content", F.col("policy_hash").alias("p"), F.col("source_hash").alias("s"), F.lit(True).alias("there"))
    schema = _schema(spark, root)
    bad = F.lit(False)
    if verify and schema is not None:
        names = sorted(f.name for f in schema.fields)
        now = _scan(spark, root, schema).groupBy(ATTEMPT, BUNDLE).agg(F.sha2(bag_hash(*names), 256).alias("now"))
        have = have.join(now, [ATTEMPT, BUNDLE], "left")
        bad = ~F.col("content").eqNullSafe(F.col("now"))
    j = wanted.join(have, BUNDLE, "left")
    other = ~(F.col("policy_hash").eqNullSafe(F.col("p")) & F.col("source_hash").eqNullSafe(F.col("s")))
    return j.select(BUNDLE, F.when(F.col("there").isNull(), "PROCESS").when(other, "CONFLICT_PROVENANCE").when(bad, "CONFLICT_INVALID_BUNDLE").otherwise("SKIP").alias("status"))


def abandoned(spark: SparkSession, root: str) -> list[str]:
    """Attempts in no commit of any version: what publishers left that died or lost.  Whoever
    deletes them must know that none is still at work."""
    there = {n.split("=", 1)[1] for n in _names(spark, f"{root}/data") if n.startswith(f"{ATTEMPT}=")}
    said = set()
    for folder in _names(spark, f"{root}/log"):
        texts = spark.read.text(f"{root}/log/{folder}", pathGlobFilter="*.json")
        said |= {r[0] for r in texts.select(F.get_json_object("value", "$.attempt")).collect()}
    return sorted(there - said)
