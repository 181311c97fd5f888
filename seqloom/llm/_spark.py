"""Session helpers shared by the operators: code shipping, columns, shared tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch.  Documents are long, so a batch holds a few hundred of them.
ARROW_ROWS = 256
_DEFAULT_ARROW_ROWS = "10000"
_local_dirs: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Make the session fit for operators with Arrow batches of documents.

    Ships this package to the executors (they need not have it installed) and, unless
    the user chose a batch size, lowers the rows of an Arrow batch to ``ARROW_ROWS``.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == _DEFAULT_ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    sc = spark.sparkContext
    name = "seqloom_package.zip"
    if name not in sc._python_includes:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="seqloom-")) / name
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(path))
    return spark


def numbered(docs: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns renamed to c0, c1, ... by position, so that no name of the
    user's can clash with an operator's, and the new names of the ``wanted`` columns.

    A wanted column is the one of exactly that name, else the only one that differs in case.
    """
    names, found = docs.columns, []
    for w in wanted:
        at = [i for i, n in enumerate(names) if n == w] or [i for i, n in enumerate(names) if n.lower() == w.lower()]
        if len(at) != 1:
            raise ValueError(f"one column {w!r} is needed, of {names}")
        found.append(f"c{at[0]}")
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), found


def columns(docs: DataFrame, *wanted: str) -> DataFrame:
    """Only the ``wanted`` columns, whatever else ``docs`` holds."""
    d, found = numbered(docs, *wanted)
    return d.select(*found).toDF(*wanted)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint
    folder.  Where neither is set, a local folder serves a session on one machine; on a
    cluster its executors would each write to their own disk, so that is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="seqloom-shared-")
        atexit.register(shutil.rmtree, _local_dirs[app], ignore_errors=True)
    return "file://" + _local_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which is deleted when the driver's JVM ends."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


#: Spark's setting by which a query's shuffle files go when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writes = threading.Lock()
_writing: dict[int, tuple[int, str | None]] = {}


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files.  They would stay until the driver
    happens to collect its garbage, however many there are by then."""
    key = id(spark)
    with _writes:
        n, before = _writing.get(key) or (0, spark.conf.get(_CLEANUP, None))
        _writing[key] = n + 1, before
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _writes:
            n, before = _writing.pop(key)
            if n > 1:
                _writing[key] = n - 1, before
            elif before is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, before)


def _write(df: DataFrame, path: str) -> DataFrame:
    # Hashes and texts gain nothing from dictionaries; small row groups keep writers small.
    options = {"compression": "zstd", "parquet.enable.dictionary": "false", "parquet.block.size": str(16 << 20)}
    with _shuffles_go(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: it is computed once,
    its lineage is cut, and a lost executor takes nothing with it."""
    return _write(df, new_path(df.sparkSession, name))
