"""Token-id output as ORC: sorted shards, run-length encoded ids, row indexes, Bloom filters.

A shard is one ORC file with a contiguous range of doc_ids in ascending order.  ORC keeps
integers run-length encoded (RLE v2), with a row index every ``row_index_stride`` rows and
a Bloom filter on doc_id, so readers take stripes in parallel and skip those that cannot
hold an id they look for.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import columns, new_path, prepare
from .tokens import encoded

FILE_SCHEMA = "shard int, doc_id long, shard_start long, n_tokens long, tokens array<int>"


def _encode(spec, end_id: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, done = TaskContext.get().partitionId(), 0
        for b, ids, bounds in encoded(batches, spec.value, end_id):
            n = np.diff(bounds)
            tokens = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard), pa.int32()), b.column("doc_id"), pa.array(done + bounds[:-1], pa.int64()), pa.array(n, pa.int64()), tokens], names=["shard", "doc_id", "shard_start", "n_tokens", "tokens"])
            done += int(bounds[-1])

    return run


def write_token_orc(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None, shards: int | None = None, stripe_bytes: int = 32 << 20, row_index_stride: int = 1000) -> None:
    """Encode every whole text and write shards of ids in ascending doc_id order.

    The order is by doc_id (null first), a hash of the text, then text, so it is the same in
    every run, and an id with very many rows takes several shards.  A null text has no ids
    but ``end_id``; very long ones are one row.  Repeated rows are written each, in one
    shard.  An empty table gives a folder without rows.  Other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one tokenizer file, a few MB
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    d = d.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    (
        d.select("doc_id", "text")
        .mapInArrow(_encode(spec, end_id), FILE_SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.row.index.stride", str(row_index_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """The rows of a written folder; with ``doc_ids`` (a short list) only theirs, for which
    stripe statistics, row indexes and Bloom filters let the reader skip the rest."""
    df = spark.read.schema(FILE_SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(list(doc_ids)))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tokens = b.column("tokens")
        ids, bounds = np.asarray(tokens.flatten()).astype("<u4"), np.concatenate(([0], np.cumsum(np.asarray(tokens.value_lengths()), dtype=np.int64)))
        raw = memoryview(np.ascontiguousarray(ids)).cast("B")
        crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("doc_id"), b.column("shard_start"), pa.array(np.diff(bounds), pa.int64()), pa.array(crc, pa.int64())], names=["shard", "doc_id", "shard_start", "n_tokens", "ids_crc32"])


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a written folder, from the ids in the files: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids)."""
    prepare(spark)
    rows = read_token_orc(spark, path).mapInArrow(_digests, "shard int, doc_id long, shard_start long, n_tokens long, ids_crc32 long")
    # One row for each shard: the only window over a single partition.
    sizes = read_token_orc(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    before = sizes.select("shard", (F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("ids")).alias("before"))
    return rows.join(F.broadcast(before), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")


def token_orc_round_trip(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2) -> DataFrame:
    """Write ``docs`` to a new folder beside the checkpoints, and its ``token_index``."""
    path = new_path(docs.sparkSession, "token-orc")
    write_token_orc(docs, path, tokenizer_path, end_id)
    return token_index(docs.sparkSession, path)
