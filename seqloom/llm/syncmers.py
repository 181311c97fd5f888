"""Document fingerprints from closed syncmers.

A window of ``k`` words is a closed syncmer if the smallest hash among its inner grams of
``s`` words is that of the first or the last.  Whether it is chosen depends on its own words
alone, so a passage keeps its anchors wherever it stands.  A fingerprint is the sequence of
all anchors of a text, each with the position of its first word, so it grows with the text.

Two fingerprints are matched by position: equal anchors are paired (the first with the first,
and so on), and the longest chain of pairs that stand in the same order in both counts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from ._spark import columns, prepare

K_WORDS, S_WORDS = 8, 2
_INNER, _OUTER = 0x8F3F73B5CF1C9ADF, 0x6A5D39EAE12657A9


def closed_syncmers(w: K.Words, k: int = K_WORDS, s: int = S_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Word indices and hashes of all closed syncmers of a batch.  A text of 1 to k - 1 words
    has one anchor, its whole word sequence."""
    h = w.hashes()
    at = K.windows(w.first, k)
    if len(at):
        inner = K.spans_hash(h, np.arange(len(h) - s + 1), np.arange(s, len(h) + 1), _INNER)
        least = K.sliding_min(inner, k - s + 1)[at]
        at = at[(inner[at] == least) | (inner[at + k - s] == least)]
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    starts = np.concatenate((at, w.first[short]))
    ends = np.concatenate((at + k, w.first[short + 1]))
    by = np.argsort(starts, kind="stable")
    return starts[by], K.spans_hash(h, starts[by], ends[by], _OUTER)


class Sketch(NamedTuple):
    """Anchors of a text in its order: 32-bit hashes and word positions."""

    hashes: np.ndarray
    positions: np.ndarray


def sketches(w: K.Words, k: int, s: int) -> list[Sketch]:
    """All closed syncmers of each text."""
    at, h = closed_syncmers(w, k, s)
    h = (h >> K.U64(32)).astype(np.uint32)
    bounds = np.searchsorted(at, w.first)
    return [Sketch(h[a:b], at[a:b] - w.first[i]) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]


def _numbered(h: np.ndarray) -> np.ndarray:
    """Hashes joined with which occurrence of its hash each is."""
    order = np.argsort(h, kind="stable")
    x = h[order]
    new = np.concatenate(([True], x[1:] != x[:-1]))
    at = np.arange(len(x))
    out = np.empty(len(h), np.uint64)
    out[order] = (x.astype(np.uint64) << np.uint64(32)) + (at - np.maximum.accumulate(np.where(new, at, 0))).astype(np.uint64)
    return out


def matches(a: Sketch, b: Sketch) -> list[tuple[int, int]]:
    """Positional matching: the longest chain of equal anchors, as indices in a and in b,
    that stand in the same order in both."""
    if not len(a.hashes) or not len(b.hashes):
        return []
    _, i, j = np.intersect1d(_numbered(a.hashes), _numbered(b.hashes), assume_unique=True, return_indices=True)
    by = np.argsort(i)
    i, j = i[by], j[by].tolist()
    if all(x < y for x, y in zip(j, j[1:])):
        return list(zip(i.tolist(), j, strict=True))
    # The longest increasing run of b's places: ends[n] is the least end of a chain of n + 1.
    ends, which, before = [], [], []
    for at, place in enumerate(j):
        n = bisect_left(ends, place)
        before.append(which[n - 1] if n else -1)
        ends[n : n + 1] = [place]
        which[n : n + 1] = [at]
    chain, at = [], which[-1] if which else -1
    while at >= 0:
        chain.append((int(i[at]), j[at]))
        at = before[at]
    return chain[::-1]


def likeness(a: Sketch, b: Sketch) -> float:
    """Anchors in the chain of both, of all anchors of both.  Two empty sketches are alike, an
    empty and another not."""
    total = len(a.hashes) + len(b.hashes)
    common = len(matches(a, b))
    return common / (total - common) if total else 1.0


def as_text(x: Sketch) -> str:
    """``hash@position`` of each anchor in turn, comma-joined."""
    return ",".join([f"{h:08x}@{p}" for h, p in zip(x.hashes.tolist(), x.positions.tolist(), strict=True)])


def from_text(fingerprint: str) -> Sketch:
    pairs = [x.split("@") for x in fingerprint.split(",") if x]
    return Sketch(np.array([int(h, 16) for h, _ in pairs], np.uint32), np.array([int(p) for _, p in pairs], np.int64))


def fingerprints(docs: DataFrame, k: int = K_WORDS, s: int = S_WORDS) -> DataFrame:
    """doc_id, n_anchors long (closed syncmers of the whole text), fingerprint string
    (``hash@position`` of each, comma-joined; equal texts have equal ones).

    A null or wordless text has no anchors and the fingerprint ''; a very long one has all of
    its anchors.  Repeated rows are fingerprinted each; an empty table gives an empty one;
    other columns are ignored.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            found = sketches(K.words(K.texts(b.column("text"))), k, s)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(x.hashes) for x in found], pa.int64()), pa.array([as_text(x) for x in found], pa.string())], names=["doc_id", "n_anchors", "fingerprint"])

    return columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_anchors long, fingerprint string")


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(k: int, s: int):
    def sketch(texts: list[str]):
        return sketches(K.words(K.texts(pa.array(texts, pa.large_string()))), k, s)

    def judge(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
        edited = [_edit(a, b) for a, b in zip(texts, following, strict=True)]
        own, other = sketch(texts), sketch(edited)
        nxt = [*own[1:], *sketch(following[-1:])]  # texts are in order, without a gap
        rows = [ids, [len(t) for t in texts], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [as_text(x) for x in own], [as_text(x) for x in other], [likeness(a, b) for a, b in zip(own, other, strict=True)], [likeness(a, b) for a, b in zip(own, nxt, strict=True)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, _SCHEMA, strict=True)], names=[n for n, _ in _SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (block, guest, order); the row after a document is its next one.
        A block ends with its guest, the first document of the following block."""
        held: tuple | None = None
        for b in K.pieces(batches):
            cols = [b.column(n).to_pylist() for n in ("block", "guest", "doc_id", "text")]
            ids, texts, following = [], [], []
            for row in zip(*cols, strict=True):
                block, guest, doc, text = row[0], row[1], row[2], row[3] or ""
                if held is not None and held[0] == block:
                    ids.append(held[1])
                    texts.append(held[2])
                    following.append(text)
                held = None if guest else (block, doc, text)
                if texts and held is None:
                    # The chain of texts breaks here: what follows is not the next one's next.
                    yield judge(ids, texts, following)
                    ids, texts, following = [], [], []
            if texts:
                yield judge(ids, texts, following)

    return run


class Blocks:
    """Blocks of neighbouring documents in descending order of doc_id, nulls last.

    ``cuts`` are doc_ids at equal steps through the table.  An id that two cuts or more name
    has a segment of its own, of as many blocks as it takes steps, and so have null ids; such
    blocks share the segment's rows by the hash of their texts, in its order.
    """

    def __init__(self, cuts: list[int], null_blocks: int):
        often = Counter(cuts)
        edges = sorted(set(cuts) | {q + 1 for q, n in often.items() if n > 1 and q < np.iinfo(np.int64).max})
        self.edges = np.array(edges, np.int64)
        # Segment j of ascending ids holds those with j edges at or below them.
        parts = np.array([1, *[max(1, often.get(e, 0)) for e in edges]])
        self.parts = np.append(parts[::-1], max(1, null_blocks))
        self.start = np.cumsum(self.parts) - self.parts
        self.n = int(self.parts.sum())

    def of(self, ids: pa.Array, h: np.ndarray) -> np.ndarray:
        segment = len(self.edges) - np.searchsorted(self.edges, np.asarray(ids.fill_null(0)), side="right")
        segment[np.asarray(ids.is_null())] = len(self.edges) + 1
        step = (h.astype(np.int64).view(K.U64) ^ K.U64(1 << 63)) >> K.U64(32)  # in the order of signed hashes
        return self.start[segment] + ((step * self.parts[segment].astype(K.U64)) >> K.U64(32)).astype(np.int64)


def edited_fingerprints(docs: DataFrame, k: int = K_WORDS, s: int = S_WORDS, blocks: int | None = None) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text has the last floor(n/2) of n code points replaced by the first as many
    (or all) of the next document, in descending order of doc_id (null last; equal ids by a
    hash of their text, then by text), and after the last document the first comes again.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    Documents are dealt into blocks of neighbours, an id with very many rows into several;
    each block gets as a guest one row of the next block, its first.  So the texts are
    shuffled once, and no window runs over the whole table.  Rows that agree in doc_id and
    text are in one block, which reads them as a stream.  A null text is empty; very long
    ones are taken whole.  A table of one row is its own next document; an empty table gives
    an empty one; other columns are ignored.
    """
    spark = prepare(docs.sparkSession)
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    steps = ", ".join(f"{i / n:.9f}D" for i in range(1, n)) or "0.5D"
    seen = d.agg(F.expr(f"approx_percentile(doc_id, array({steps}), 10000)").alias("q"), F.count(F.lit(1)).alias("rows"), F.count("doc_id").alias("ids")).first()
    if not seen["rows"]:
        return spark.createDataFrame([], _SQL)
    # n - 1 numbers at most go to the driver, and from it to the tasks.
    dealt = Blocks(list(seen["q"] or []), -(-n * (seen["rows"] - seen["ids"]) // seen["rows"]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(dealt.of(b.column("doc_id"), np.asarray(b.column("h"))), pa.int32()), b.column("doc_id"), b.column("h")], names=["block", "doc_id", "h"])

    d = d.withColumn("h", F.xxhash64("text"))
    # The first of a block has its largest id, and of that the least hash.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), (-F.col("doc_id").cast("decimal(20,0)")).alias("down"), F.col("h").alias("h"))
    heads = d.select("doc_id", "h").mapInArrow(place, "block int, doc_id long, h long").groupBy("block").agg(F.min(order).alias("m")).orderBy("block").collect()
    named = [(r["block"], None if r["m"]["no_id"] else -int(r["m"]["down"]), r["m"]["h"]) for r in heads]  # one row a block: 2 n at most
    first_id, first_hash, host = np.zeros(dealt.n, np.int64), np.zeros(dealt.n, np.int64), np.full(dealt.n, -1)
    for i, (block, doc, h) in enumerate(named):
        first_id[block], first_hash[block], host[block] = doc or 0, h, named[i - 1][0]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = np.asarray(b.column("h"))
            block = dealt.of(b.column("doc_id"), h)
            head = np.flatnonzero((np.asarray(b.column("doc_id").fill_null(0)) == first_id[block]) & (h == first_hash[block]))
            guest = head[np.unique(block[head], return_index=True)[1]]  # of equal rows one is enough
            rows = pa.array(np.concatenate((np.arange(len(block)), guest)))
            t = b.take(rows)
            where = np.concatenate((block, host[block[guest]]))
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), t.column("text"), t.column("h"), pa.array(where, pa.int32()), pa.array(np.arange(len(rows)) >= len(block))], names=["doc_id", "text", "h", "block", "guest"])

    d = d.mapInArrow(deal, "doc_id long, text string, h long, block int, guest boolean").repartitionById(dealt.n, "block")
    d = d.sortWithinPartitions("block", "guest", F.col("doc_id").desc_nulls_last(), F.col("h").asc(), F.col("text").asc())
    return d.mapInArrow(_compare(k, s), _SQL)
