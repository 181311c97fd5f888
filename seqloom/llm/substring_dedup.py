"""Substring dedup: Rabin-Karp window hashes, counted in Spark, merged to maximal intervals.

Every window of ``window`` consecutive words of every text is hashed.  Counting runs in
two rounds that together decide each window exactly:

1. The smallest Rabin-Karp hash of the ``window - gram + 1`` grams inside a window is its
   anchor; equal windows have equal anchors.  Neighbouring windows with one anchor form a
   run (about 15 windows), so the rows that are shuffled by anchor are a fifteenth of the
   windows.  An anchor met once settles its windows as unique; runs that are equal as a
   whole settle theirs as repeated.
2. For what is left (runs that share an anchor but differ somewhere) each window is
   counted by anchor and hash, so two different windows meet only if two independent
   64-bit hashes collide.

The first round reads runs sorted by hash as a stream with one row of state, so no group is
held in memory.  Windows in a row with equal hashes travel as one row with a length.
Repeated rows share a key of 96 bits, and what is found for it is kept once.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from ._spark import columns, numbered, prepare, stored

_GRAM_BASE, _RUN_BASE, _WINDOW_BASE = 0x2545F4914F6CDD1D, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_RUNS = "anchor long, run_hash long, row_key long, row_sub int, start int, n int, twice boolean"
_FOUND = "row_key long, row_sub int, start int, n int, anchor long, settled boolean"
_HITS = "h long, anchor long, row_key long, row_sub int, start int, n int"
_KEY = ["row_key", "row_sub"]


def _table(schema: list[tuple[str, pa.DataType]], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


def _emit_runs(window: int, gram: int):
    grams = window - gram + 1
    schema = [("anchor", pa.int64()), ("run_hash", pa.int64()), ("row_key", pa.int64()), ("row_sub", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("twice", pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            w = K.words(K.texts(b.column("text")))
            at = K.windows(w.first, window)
            if not len(at):
                continue
            h = w.hashes()
            g = K.spans_hash(h, np.arange(len(h) - gram + 1), np.arange(gram, len(h) + 1), _GRAM_BASE)
            anchor = K.sliding_min(g, grams)[at]
            doc = np.searchsorted(w.first, at, side="right") - 1
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1
            whole = K.spans_hash(h, at[first], at[last] + window, _RUN_BASE)
            # A periodic stretch can repeat a window inside one run.
            x, of = K.spans_hash(h, at, at + window, _WINDOW_BASE), np.cumsum(new) - 1
            by = np.lexsort((x, of))
            again = (x[by][1:] == x[by][:-1]) & (of[by][1:] == of[by][:-1])
            twice = np.zeros(len(first), bool)
            twice[of[by][1:][again]] = True
            keys, subs = b.column("row_key").to_numpy(), b.column("row_sub").to_numpy()
            yield _table(schema, [K.signed(anchor[first]), K.signed(whole), keys[doc[first]], subs[doc[first]], (at[first] - w.first[doc[first]]), last - first + 1, twice])

    return run


def _settle_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs sorted by (anchor, run_hash): those that repeat as a whole (settled), and
    those, or one of equal ones, whose windows must be compared with other runs of the anchor."""
    schema = [("row_key", pa.int64()), ("row_sub", pa.int32()), ("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("settled", pa.bool_())]
    held, was_same, was_anchor, was_varied = None, False, False, False

    def judge(rows, same_before, anchor_before, varied, same_after, anchor_after):
        a, _, key, sub, start, n, twice = rows
        settled = same_before | same_after
        ask = ~settled & (anchor_before | anchor_after | twice)
        # Of equal runs the last speaks for all, if the anchor has other runs as well.
        ask |= settled & ~same_after & (varied | anchor_after)
        out = [np.concatenate((x[settled], x[ask])) for x in (key, sub, start, n, a)]
        return _table(schema, [*out, np.concatenate((np.ones(settled.sum(), bool), np.zeros(ask.sum(), bool)))])

    for b in batches:
        rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
        if not len(rows[0]):
            continue
        if held is not None:
            rows = [np.concatenate((x, y)) for x, y in zip(held, rows, strict=True)]
        a, r = rows[0], rows[1]
        anchor_eq = a[1:] == a[:-1]
        same_eq = anchor_eq & (r[1:] == r[:-1])
        same_before = np.concatenate(([was_same], same_eq))
        anchor_before = np.concatenate(([was_anchor], anchor_eq))
        changes = np.cumsum(anchor_before & ~same_before) + int(was_varied)
        base = np.maximum.accumulate(np.where(anchor_before, 0, changes))
        varied = changes > base
        held = [x[-1:] for x in rows]
        if len(a) > 1:
            yield judge([x[:-1] for x in rows], same_before[:-1], anchor_before[:-1], varied[:-1], same_eq, anchor_eq)
        was_same, was_anchor, was_varied = bool(same_before[-1]), bool(anchor_before[-1]), bool(varied[-1])
    if held is not None:
        no = np.zeros(1, bool)
        yield judge(held, np.array([was_same]), np.array([was_anchor]), np.array([was_varied]), no, no)


def _flat(b: pa.RecordBatch, name: str) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Row of each entry of an array-of-structs column, and the entries' fields."""
    col = b.column(name)
    lens = np.asarray(col.value_lengths().fill_null(0))
    flat = col.flatten()
    return np.repeat(np.arange(len(col)), lens), {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _emit_windows(window: int):
    schema = [("h", pa.int64()), ("anchor", pa.int64()), ("row_key", pa.int64()), ("row_sub", pa.int32()), ("start", pa.int32()), ("n", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            row, ask = _flat(b, "asks")
            if not len(row):
                continue
            used = np.unique(row)
            part = b.take(pa.array(used))
            row = np.searchsorted(used, row)
            w = K.words(K.texts(part.column("text")))
            h = w.hashes()
            n = ask["n"].astype(np.int64)
            total = np.cumsum(n)
            inside = np.arange(total[-1]) - np.repeat(total - n, n)
            at = np.repeat(w.first[row] + ask["start"], n) + inside
            x = K.spans_hash(h, at, at + window, _WINDOW_BASE)
            which = np.repeat(np.arange(len(n)), n)
            new = np.concatenate(([True], (x[1:] != x[:-1]) | (which[1:] != which[:-1])))
            first = np.flatnonzero(new)
            length = np.diff(np.append(first, len(x)))
            doc = row[which[first]]
            yield _table(schema, [K.signed(x[first]), ask["anchor"][which[first]], part.column("row_key").to_numpy()[doc], part.column("row_sub").to_numpy()[doc], at[first] - w.first[doc], length])

    return run


def _kept_texts(b: pa.RecordBatch, window: int) -> Iterator[tuple[bytes, int, np.ndarray, np.ndarray, int]]:
    """For each text its bytes after removal (words joined by one space), number of words,
    the removed intervals' starts and ends, and the number of removed words."""
    w = K.words(K.texts(b.column("text")))
    row, hit = _flat(b, "hits")
    begin = w.first[row] + hit["start"]
    gone = K.covered(len(w.starts), begin, begin + hit["n"] + window - 1)
    data = w.texts.data
    for i in range(b.num_rows):
        lo, hi = w.first[i], w.first[i + 1]
        keep = np.flatnonzero(~gone[lo:hi]) + lo
        if len(keep) == hi - lo:
            text = b" ".join(data[w.texts.offsets[i] : w.texts.offsets[i + 1]].tobytes().split())
        else:
            text = b" ".join([data[s:e].tobytes() for s, e in zip(w.starts[keep], w.ends[keep], strict=True)])
        yield text, int(hi - lo), *K.runs(gone[lo:hi]), int(hi - lo - len(keep))


def _digest(window: int):
    schema = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            rows = [(n, gone, hashlib.sha256(text).hexdigest(), [{"start": x, "end": y} for x, y in zip(s.tolist(), e.tolist(), strict=True)]) for text, n, s, e, gone in _kept_texts(b, window)]
            yield _table(schema, [b.column("doc_id"), *([r[i] for r in rows] for i in range(4))])

    return run


def _strip(window: int, names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            old = b.column("text").to_pylist()
            new = [kept.decode() if gone else was for was, (kept, *_, gone) in zip(old, _kept_texts(b, window), strict=True)]
            made = {name: pa.array(new, pa.string()) if name == text else b.column(name) for name in names}
            yield pa.RecordBatch.from_arrays(list(made.values()), names=names)

    return run


def _with_hits(d: DataFrame, window: int, gram: int) -> DataFrame:
    """``d`` (with text, row_key and row_sub) and, for each row, its repeated windows."""
    if not 1 <= gram <= window:
        raise ValueError("gram must be between 1 and window")
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = d.select(*_KEY, "text").mapInArrow(_emit_runs(window, gram), _RUNS)
    found = runs.repartition(n, "anchor").sortWithinPartitions("anchor", "run_hash").mapInArrow(_settle_runs, _FOUND)
    found = stored(found, "substring-runs")
    # Sets, not lists: what the copies of a row are found to hold is the same for all of them.
    asks = found.where("not settled").groupBy(*_KEY).agg(F.collect_set(F.struct("start", "n", "anchor")).alias("asks"))
    # All joins deal the rows out by the same key and columns, so Spark shuffles them once.
    windows = d.join(asks, _KEY, "left").mapInArrow(_emit_windows(window), _HITS)
    # Counts are added up before the shuffle.  The third key keeps the few repeated windows
    # from standing where the sums were made, so that both sides of the join are dealt out
    # anew and Spark may split a window that has very many places.
    often = windows.groupBy("h", "anchor", F.pmod("h", F.lit(2)).alias("half")).agg(F.sum("n").alias("times")).where("times > 1").select("h", "anchor")
    repeated = windows.join(often, ["h", "anchor"]).select(*_KEY, "start", "n")
    hits = repeated.unionByName(found.where("settled").select(*_KEY, "start", "n"))
    hits = hits.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "n")).alias("hits"))
    return d.join(hits, _KEY, "left")


def _keyed(d: DataFrame, doc_id: str, text: str) -> DataFrame:
    return d.withColumns({"row_key": F.xxhash64(doc_id, text), "row_sub": F.hash(text, doc_id)})


def remove_repeated_substrings(docs: DataFrame, window: int = 35, gram: int = 8) -> DataFrame:
    """What removing every word that a repeated window of ``window`` words covers leaves.

    A window repeats if its word sequence starts anywhere else in the corpus, in the same
    document included; all copies go.  Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

    Returns per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words
    joined by one space), removed (maximal intervals of word positions, half open).

    Nulls: a null text has no words; a null doc_id is kept as null.  Texts of fewer than
    ``window`` words lose nothing; very long ones are taken whole.  Repeated rows are
    documents like any other, so a row that is there twice loses all its windows in both.
    Rows are told apart by 96 bits of hashes of doc_id and text, so equal ids with different
    texts don't mix.  An empty table gives an empty table; other columns are ignored.
    """
    prepare(docs.sparkSession)
    d = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_hits(_keyed(d, "doc_id", "text"), window, gram).mapInArrow(_digest(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>")


def strip_repeated_substrings(docs: DataFrame, window: int = 35, gram: int = 8) -> DataFrame:
    """``docs`` with the texts that are left: same rows and columns, whatever their names and
    types.  A text that loses words becomes its kept words joined by one space; others stay
    as they are.  A column n_chars, if there, is set to the new length.  Other cases are
    those of ``remove_repeated_substrings``."""
    prepare(docs.sparkSession)
    d, (doc_id, text) = numbered(docs, "doc_id", "text")
    names = d.columns
    hits = _with_hits(_keyed(d, doc_id, text).withColumnRenamed(text, "text"), window, gram).drop(*_KEY)
    out = hits.mapInArrow(_strip(window, names, text), d.schema)
    if "n_chars" in docs.columns:
        i = docs.columns.index("n_chars")
        out = out.withColumn(names[i], F.coalesce(F.length(text), F.lit(0)).cast(d.schema[names[i]].dataType))
    return out.toDF(*docs.columns)
