"""Quality rules: suffix-array repetition and simple text counts.

Per document a suffix array over its words is built by prefix doubling, for all documents
of a batch at once; a suffix leaves the sort as soon as its order is known.  Longest common
prefixes of neighbours in the array give the maximal repeated substrings; the union of
those of at least ``min_repeat`` words is the covered part of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import kernel as K
from ._spark import columns, numbered, prepare

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: The method's limits: repeats count from MIN_REPEAT words; a text fails if they cover more
#: than MAX_COVERED of its words, or one is longer than MAX_LONGEST of them.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 8, 0.30, 0.20

_SCHEMA = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("covered_words", pa.int64()), ("longest_repeat", pa.int64())]
_SQL = ", ".join(f"{n} long" for n, _ in _SCHEMA)


def longest_repeats(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position of the sequences ids[first[i]:first[i + 1]], the length of the
    longest substring that starts there and at another position of the same sequence.

    Suffixes are ordered within their sequence, a shorter one before its extensions.
    """
    n = len(ids)
    if n < 2:
        return np.zeros(n, np.int64)
    # A rank array for each doubling is kept: places take four bytes where they can.
    kind = np.int32 if n < 1 << 30 else np.int64
    doc = np.repeat(np.arange(len(first) - 1, dtype=kind), np.diff(first))
    end = first[1:].astype(kind)[doc]
    # Rank of a suffix: the place of its group's first member in the array.
    order = np.lexsort((ids, doc)).astype(kind)
    key_new = np.concatenate(([True], (doc[order][1:] != doc[order][:-1]) | (ids[order][1:] != ids[order][:-1])))
    rank = np.empty(n, kind)
    rank[order] = np.maximum.accumulate(np.where(key_new, np.arange(n, dtype=kind), 0))
    levels, h = [(1, rank)], 1
    head = np.flatnonzero(key_new)
    size = np.diff(np.append(head, n))
    open_ = np.repeat(size > 1, size)
    while open_.any():
        slots = np.flatnonzero(open_)
        suffix = order[slots]
        nxt = suffix + kind(min(h, n))
        second = np.where(nxt < end[suffix], rank[np.minimum(nxt, n - 1)] + 1, 0)
        group = rank[suffix]
        by = np.lexsort((second, group))
        suffix, second, group = suffix[by], second[by], group[by]
        order[slots] = suffix
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (second[1:] != second[:-1])))
        place = np.maximum.accumulate(np.where(new, slots, 0)).astype(kind)
        rank = rank.copy()
        rank[suffix] = place
        h *= 2
        levels.append((h, rank))
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(slots)))
        open_ = np.zeros(n, bool)
        open_[slots] = np.repeat(size > 1, size)
    # Common prefix of neighbours, by halving: equal ranks at level h mean h equal words.
    left, right = order[:-1], order[1:]
    near = doc[left] == doc[right]
    left, right = left[near].copy(), right[near].copy()
    length = np.zeros(len(left), kind)
    a, b = left.copy(), right.copy()
    while levels:
        h, r = levels.pop()
        live = np.flatnonzero((a + h <= end[left]) & (b + h <= end[right]))
        same = live[r[a[live]] == r[b[live]]]
        length[same] += h
        a[same] += h
        b[same] += h
    out = np.zeros(n, np.int64)
    np.maximum.at(out, left, length)
    np.maximum.at(out, right, length)
    return out


def measures(column: pa.Array, min_repeat: int) -> list[np.ndarray]:
    """The columns of _SCHEMA for each text."""
    t = K.texts(column)
    w = K.words(t)
    n_docs, n_bytes = len(t.offsets) - 1, len(t.data)
    if not n_bytes:
        return [np.zeros(n_docs, np.int64) for _ in _SCHEMA]
    points = ~SPACE_OR_TAIL[t.data]
    h, doc = w.hashes(), w.doc()
    # Lines start at a text's start and after each \n; they end before a \n or at the text's end.
    edge = np.flatnonzero(t.data == 10)
    starts = np.unique(np.concatenate((edge + 1, t.offsets[:-1])))
    starts = starts[starts < n_bytes]
    stop = np.minimum(np.append(edge, n_bytes)[np.searchsorted(edge, starts)], t.offsets[np.searchsorted(t.offsets, starts, side="right")])
    words_in = np.searchsorted(w.starts, stop) - np.searchsorted(w.starts, starts)
    starts, stop = starts[words_in > 0], stop[words_in > 0]
    line_doc = np.searchsorted(t.offsets, starts, side="right") - 1
    line = K.spans_hash(K._BYTE[t.data], starts, stop)
    order = np.lexsort((line, line_doc))
    same = (line[order][1:] == line[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    dup_lines = np.bincount(line_doc[order][1:][same], minlength=n_docs)
    # Words in 3-word windows found twice or more.
    at = K.windows(w.first, 3)
    gram = K.spans_hash(h, at, at + 3)
    order = np.lexsort((gram, doc[at]))
    g, d = gram[order], doc[at][order]
    same = (g[1:] == g[:-1]) & (d[1:] == d[:-1])
    often = np.zeros(len(at), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    repeat = K.covered(len(h), at[often], at[often] + 3)
    longest = longest_repeats(h, w.first)
    spans = np.flatnonzero(longest >= max(1, min_repeat))
    cover = K.covered(len(h), spans, spans + longest[spans])
    most = np.zeros(n_docs, np.int64)
    np.maximum.at(most, doc, longest)
    return [w.counts, K.per_text_sum(points, t.offsets), K.per_text_sum(SYMBOLS[t.data], t.offsets), dup_lines, K.per_text_sum(repeat, w.first), K.per_text_sum(cover, w.first), most]


SPACE_OR_TAIL = K.SPACE.copy()
SPACE_OR_TAIL[0x80:0xC0] = True  # the later bytes of a code point


def _measure(min_repeat: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches, text):
            made = [pa.array(x, t) for x, (_, t) in zip(measures(b.column(text), min_repeat), _SCHEMA, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *(n for n, _ in _SCHEMA)])

    return run


def _judged(d: DataFrame, text: str, min_repeat: int, max_covered: float, max_longest: float) -> tuple[DataFrame, Column, Column]:
    """``d`` with the counts of each text, whether the base rules fail it, and the verdict."""
    schema = StructType([*d.schema.fields, *[StructField(n, LongType()) for n, _ in _SCHEMA]])
    m, n = d.mapInArrow(_measure(min_repeat, text), schema), F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    longest = F.when(F.col("longest_repeat") >= min_repeat, F.col("longest_repeat")).otherwise(0)
    return m, failed, ~failed & (F.col("covered_words") <= max_covered * n) & (longest <= max_longest * n)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names.
    Cases are those of ``quality_rules``."""
    prepare(docs.sparkSession)
    d, (text,) = numbered(docs, "text")
    m, _, kept = _judged(d, text, MIN_REPEAT, MAX_COVERED, MAX_LONGEST)
    return m.where(kept).select(d.columns).toDF(*docs.columns)


def quality_rules(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """Counts and verdict for every whole text; no shuffle.

    Base rules fail a text of fewer than 50 words, or with more than half of its words in
    3-word windows that are found twice or more.  The method fails it if repeated substrings
    of ``min_repeat`` words or more cover more than ``max_covered`` of its words, or if the
    longest is more than ``max_longest`` of them.

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    covered_words, longest_repeat (long), base_failed, kept (boolean).

    A null text has no words, so it fails; repeated rows are judged each; an empty table
    gives an empty one; other columns are ignored.  A text is worked on whole, in one task: a
    very long one takes about 150 bytes of memory a word at most, whatever it repeats.
    """
    prepare(docs.sparkSession)
    d = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    m, failed, kept = _judged(d, "text", min_repeat, max_covered, max_longest)
    return m.select("doc_id", *[n for n, _ in _SCHEMA], failed.alias("base_failed"), kept.alias("kept"))
