"""Best-fit packing with certified bin counts.

Pieces are dealt into parts by their row number (never by a key of the data), so that each part holds
a bounded number of pieces, and every part, also a single one, is packed by best-fit
decreasing.  Lower bounds from dual-feasible functions certify a part whose number of bins
none can beat.  Parts with a gap hand back the pieces of all bins that are not full.
Certified parts hand back those of their emptiest bin, or, where large pieces and not the
sum of all set the bound, those of all bins that are not 99 % full.  What came back is dealt
anew into larger parts and packed again; once larger parts no longer narrow the gap, only
emptiest bins go on, until one part holds the rest.  Every row says whether its sequence is
certified.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import columns, prepare, stored
from .tokens import encoded

CAPACITY = 4096
#: Pieces of one part on average in the first round, and how often parts double in size: a
#: part is one task, so it can't grow with the table.
PART_PIECES, DOUBLINGS = 25_000, 4


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The best bound on the number of bins that these dual-feasible functions give:
    the identity, the rounding u^(k) for k = 1..20, and for each threshold t <= capacity/2
    the function that lifts sizes above capacity - t to a whole bin and drops those below t."""
    if not len(lengths):
        return 0
    sizes, counts = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(1, 21):
        scaled = (k + 1) * sizes
        u = np.where(scaled % capacity == 0, sizes * k, (scaled // capacity) * capacity)  # over k * capacity
        best = max(best, -(-int((u * counts).sum()) // (k * capacity)))
    total = np.concatenate(([0], np.cumsum(sizes * counts)))
    number = np.concatenate(([0], np.cumsum(counts)))
    for t in np.unique(np.concatenate((sizes[sizes <= capacity // 2], [0]))).tolist():
        big = np.searchsorted(sizes, capacity - t, side="right")
        low = np.searchsorted(sizes, t, side="left")
        whole = number[-1] - number[big]
        middle = total[big] - total[min(low, big)]
        best = max(best, int(whole) - (-int(middle) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins.  Items are placed one by one, the
    longest first, each in the open bin with the least room that fits it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    used = 0  # bit r: some bin has room r
    n_bins, i = 0, 0
    ordered = lengths[order].tolist()
    while i < len(ordered):
        size = ordered[i]
        if size > capacity or size < 0:
            raise ValueError("an item must fit a bin")
        fits = used >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            b = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            room, b = capacity, n_bins
            n_bins += 1
        item = order[i]
        bins[item], offsets[item] = b, capacity - room
        left = room - size
        rooms[left].append(b)
        used |= 1 << left
        i += 1
    return bins, offsets, n_bins


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def _cut(spec, end_id: int | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = TaskContext.get().partitionId() << 36
        for b, ids, bounds in encoded(batches, spec.value, end_id):
            n = np.diff(bounds)
            parts = -(-n // capacity)
            doc = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            raw = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
            at = bounds[doc] + start
            crc = [zlib.crc32(raw[4 * s : 4 * (s + m)]) for s, m in zip(at.tolist(), length.tolist(), strict=True)]
            row = rows + np.arange(len(doc))
            rows += len(doc)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(row, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, capacity: int = CAPACITY) -> DataFrame:
    """Every whole text as ids with ``end_id``, in pieces of ``capacity`` ids; only the last
    of a text may be shorter.  A null text is empty and gives one piece of ``end_id``."""
    spark = prepare(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one tokenizer file, a few MB
    return columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut(spec, end_id, capacity), _PIECES)


_PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, part int, bin int, offset long, done boolean, least boolean, certified boolean, gap int"


def _pack(capacity: int, alone: bool):
    def run(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        bins, offsets, n = best_fit_decreasing(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        gap = n - lower_bound(lengths, capacity)
        done = np.ones(n, bool)
        if not alone:
            if gap:
                done = fill == capacity
            elif n > -(-int(lengths.sum()) // capacity):
                # Certified for these pieces, but small ones of other parts may fill the gaps.
                done = fill >= capacity - capacity // 100
            else:
                done[np.argmin(fill)] = fill.min() == capacity
        certified, least = (fill == capacity) | (gap == 0), np.arange(n) == np.argmin(fill)
        made = (("bin", bins, pa.int32()), ("offset", offsets, pa.int64()), ("done", done[bins], pa.bool_()), ("least", least[bins], pa.bool_()), ("certified", certified[bins], pa.bool_()), ("gap", np.full(len(bins), gap), pa.int32()))
        for name, values, kind in made:
            group = group.append_column(name, pa.array(values, kind))
        return group

    return run


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES, doublings: int = DOUBLINGS) -> DataFrame:
    """Pieces (with columns length and row, a number of their own) and their place:
    sequence_id, offset, and certified: the sequence is full, or its part of the pieces has
    no more sequences than the lower bound.

    A piece that fills a sequence is a bin of its own and is not packed.  Each round settles
    the certified parts but for what they hand back; the rest goes to the next round, in
    parts of twice as many pieces, up to ``doublings`` times.  When parts no longer grow and a
    round narrows the sum of the gaps no further, its sequences are taken as they are, those
    of parts with a gap with certified false, and only each part's emptiest goes on.  Rounds
    end when one part holds all that is left.  sequence_id is the row of a full piece, else round, part and bin.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    made = pieces.where(F.col("length") == capacity).select(*names, F.col("row").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest = pieces.where(F.col("length") < capacity)
    n, r, before = rest.count(), 0, math.inf
    while n:
        parts = max(1, math.ceil(n / (part_pieces << min(r, doublings))))
        dealt = rest.withColumn("part", F.pmod(F.xxhash64("row", F.lit(r)), F.lit(parts)).cast("int"))
        packed = stored(dealt.groupBy("part").applyInArrow(_pack(capacity, parts == 1), _PACKED), f"packing-{r}")
        count = lambda c: F.sum(F.when(F.col(c), 1).otherwise(0))
        by_part = packed.groupBy("part").agg(F.first("gap").alias("gap"), (F.count(F.lit(1)) - count("done")).alias("back"), count("least").alias("least"))
        sums = by_part.agg(F.sum("gap").alias("gap"), F.sum("back").alias("back"), F.sum("least").alias("least")).first()
        settle = parts > 1 and r >= doublings and sums["gap"] >= before
        stays = ~F.col("least") if settle else F.col("done")  # a part alone is done
        sequence = F.shiftleft(F.lit(r + 1).cast("long"), 57) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("bin")
        made = made.unionByName(packed.where(stays).select(*names, sequence.alias("sequence_id"), "offset", "certified"))
        rest = packed.where(~stays).drop("part", "bin", "offset", "done", "least", "certified", "gap")
        n, r, before = sums["least" if settle else "back"], r + 1, math.inf if settle else sums["gap"]
    return made


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, capacity: int = CAPACITY) -> DataFrame:
    """Pack all texts into few sequences of at most ``capacity`` ids: one row for each piece,
    with doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified.

    A null or empty text is one piece of ``end_id``; very long texts are cut into full pieces.
    Repeated rows and equal ids are documents of their own.  An empty table gives an empty
    one; other columns are ignored.
    """
    return pack_pieces(stored(token_pieces(docs, tokenizer_path, end_id, capacity), "token-pieces"), capacity)
