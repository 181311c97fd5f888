"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(group | class, context) * P(word | group, context).
The frequent words of the training documents, and the end of a text, are the vocabulary, a
tree of classes, groups and words of one width.  The vocabulary, and so the width, follows the
training tokens.  Every other word belongs to a tail class by its hash, in which it has its
smoothed share of the class's training tokens, so the model is a distribution over all
words.  Features of a context are the hash of the previous word, of the one before it (a
skip), whichever words they are; with the class, group or word they predict they are the
model's bigram and skip features.  They are rows of hashed weight tables, one for each level,
whose number follows the training tokens up to a size that keeps the tables broadcastable.

Training runs in rounds of distributed gradient updates: training documents are dealt into
parts by a hash, so reruns agree however files are split, and parts are as large as pays for
the weights they send; every task takes AdaGrad steps (one rate a row of weights) on its part
from the weights of the last round, and the weights are averaged over the tasks by how often
each feature was met.

Word counts cover all training documents.  Frequent words, the vocabulary at least, are looked
up in memory; a text's other words are joined with their counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from ._spark import columns, prepare, stored

#: Tail classes; training tokens for each word of the vocabulary, within bounds on the words;
#: words whose counts are kept in memory, if the vocabulary has no more.
TAILS, TOKENS_A_WORD, LEAST_WORDS, MOST_WORDS, KEPT_WORDS = 16, 1024, (1 << 15) - 1, (1 << 21) - 1, 1 << 16
#: Classes, groups of a class and words of a group are softmaxes of one width each.
LEVELS, END = 3, 0
#: Rows of each weight table: one for so many training tokens, at least and at most so many,
#: while all tables have no more bytes than these.
TOKENS_A_ROW, LEAST_ROWS, MOST_ROWS, MODEL_BYTES = 32, 1 << 12, 1 << 16, 64 << 20
#: Rounds of training, each on its own share of the training documents; tokens of a part for
#: each row of a table (the weights a part sends are half its text then).
ROUNDS, RATES, PART_TOKENS_A_ROW = 2, (0.5, 0.25), 128
#: A row's rate is that of the round over sqrt(sum of its squared gradients / SPREAD + 1);
#: weights are kept within LIMIT after each batch, so no exponential runs over.
SPREAD, LIMIT = 16.0, 20.0
#: Tokens of one gradient step, and rows of a weight table that travel together.
STEP, SLAB = 8192, 1024
#: Groups of rows that are summed up one by one.
FEW = 8
ADD = 0.1
#: Stand for the end of a text and for what is before its start.
END_HASH, START_HASH = K.U64(0x51ED270B4D2B6F17), K.U64(0x2545F4914F6CDD1D)
_KEYS = (K.U64(0x9E3779B97F4A7C15), K.U64(0xC2B2AE3D27D4EB4F), K.U64(0x27D4EB2F165667C5))


class Model(NamedTuple):
    vocabulary: np.ndarray  # sorted hashes of the vocabulary's words
    ids: np.ndarray  # their ids, by frequency, after the end's
    width: int  # classes, groups of each, words of each
    bias: tuple  # for each level: nodes x width (the classes with the tail classes)
    weights: tuple  # for each level: rows x width
    tail_mass: np.ndarray  # smoothed tokens of each tail class


class Counts(NamedTuple):
    """Training counts: total tokens, distinct ones, ends, and the kept words with theirs."""

    n: int
    distinct: int
    ends: int
    kept: np.ndarray
    counts: np.ndarray


class Coded(NamedTuple):
    """The tokens of a batch, with an end after each text."""

    a: np.ndarray  # hash of the previous token as a feature
    b: np.ndarray  # of the one before it
    target: np.ndarray  # its id in the vocabulary, or its tail class below -1 (see tail_of)
    of: np.ndarray  # its text
    h: np.ndarray  # its hash


def tail_class(h: np.ndarray) -> np.ndarray:
    return ((h >> K.U64(7)) % K.U64(TAILS)).astype(np.int64)


def tail_of(target: np.ndarray) -> np.ndarray:
    return -1 - target


_made: dict[int, tuple] = {}  # buckets of the tables at hand, by identity


def _buckets(table: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """For a table of sorted hashes: a shift that leaves their first bits, and the first place of each value of those."""
    have = _made.get(id(table))
    if have is None or have[0] is not table:
        if len(_made) > 3:
            _made.clear()
        bits = min(24, (8 * len(table)).bit_length())
        shift = K.U64(64 - bits)
        first = np.searchsorted(table >> shift, np.arange(1 << bits, dtype=K.U64)).astype(np.int32)
        have = _made[id(table)] = (table, shift, first)
    return have[1:]


def place_of(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The places of hashes in a table of sorted, distinct ones; -1 if not there.  Buckets by
    the hashes' first bits, eight times as many as hashes, leave a probe or two each."""
    out = np.full(len(h), -1, np.int64)
    if not len(table):
        return out
    shift, first = _buckets(table)
    pos, left = first[(h >> shift).astype(np.int64)].astype(np.int64), np.arange(len(h))
    while len(left):
        inside = pos < len(table)
        left, pos = left[inside], pos[inside]
        here, want = table[pos], h[left]
        out[left[here == want]] = pos[here == want]
        go = here < want  # places are sorted: what is passed is not there
        left, pos = left[go], pos[go] + 1
    return out


def coded(w: K.Words, m: Model) -> Coded:
    n_docs = len(w.first) - 1
    words = w.hashes(lower=True)
    h = np.full(len(words) + n_docs, END_HASH, K.U64)
    h[np.arange(len(words)) + w.doc()] = words
    of = np.repeat(np.arange(n_docs), w.counts + 1)
    first = w.first[:-1] + np.arange(n_docs)
    p1, p2 = np.full(len(h), START_HASH), np.full(len(h), START_HASH)
    p1[1:], p2[2:] = h[:-1], h[:-2]
    p1[first] = START_HASH
    p2[first] = START_HASH
    p2[first[w.counts > 0] + 1] = START_HASH
    target = -1 - tail_class(h)
    if len(m.vocabulary):
        pos = place_of(h, m.vocabulary)
        target = np.where(pos < 0, target, m.ids[pos])
    target[h == END_HASH] = END
    return Coded(K.mix(p1 ^ _KEYS[0]), K.mix(p2 ^ _KEYS[1]), target, of, h)


class Choice(NamedTuple):
    """One level's choices for some tokens."""

    at: np.ndarray  # the tokens
    rows: list  # for each feature the row of weights, in 16 bits, which sort fastest
    node: np.ndarray  # where in the tree
    picked: np.ndarray  # the branch taken


def choices(x: Coded, lo: int, hi: int, m: Model) -> Iterator[Choice]:
    """The levels' choices for tokens lo to hi: classes for all, then groups and words for
    those of the vocabulary."""
    mask, target = K.U64(len(m.weights[0]) - 1), x.target[lo:hi]
    at, inside = np.arange(lo, hi), np.flatnonzero(target >= 0)
    top = np.where(target < 0, m.width + tail_of(target), target // m.width ** (LEVELS - 1))
    yield Choice(at, [(f[lo:hi] & mask).astype(np.uint16) for f in (x.a, x.b)], np.zeros(len(at), np.int64), top)
    at, target = at[inside], target[inside]
    for level in range(1, LEVELS) if len(at) else ():
        size = m.width ** (LEVELS - 1 - level)
        node = target // (size * m.width)
        key = (node + level * m.width**LEVELS).astype(K.U64) * _KEYS[2]
        yield Choice(at, [(K.mix(f[at] + key) & mask).astype(np.uint16) for f in (x.a, x.b)], node, target // size % m.width)


def _rows(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.take(table, at, axis=0, mode="clip")


def _set_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``table[at] = rows``, with each row as one item: numpy moves those several times as fast."""
    item = np.dtype((np.void, table.itemsize * table.shape[1]))
    table.view(item)[at, 0] = rows.view(item)[:, 0]


def _joined(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray], node: np.ndarray, join: np.ufunc) -> np.ndarray:
    """A bias and one row of weights for each feature, added up or multiplied."""
    z = _rows(weights, rows[0])
    for r in rows[1:]:
        join(z, _rows(weights, r), out=z)
    return join(z, bias if bias.ndim == 1 else _rows(bias, node), out=z)


def _logits(level: int, c: Choice, m: Model) -> np.ndarray:
    return _joined(m.weights[level], m.bias[level], c.rows, c.node, np.add)


def _row_sums(z: np.ndarray) -> np.ndarray:
    return z @ np.ones(z.shape[1], z.dtype)  # several times as fast as sum for short rows


def _picked(z: np.ndarray, c: Choice) -> np.ndarray:
    """Where in the flat ``z`` the branches taken are."""
    return np.arange(0, z.size, z.shape[1]) + c.picked


def factors(m: Model) -> Model:
    """The model with the exponentials of its biases and weights: a token's are multiplied, so
    scoring has no exponentials of its own.  LIMIT keeps the products within 32 bits."""
    return m._replace(bias=tuple(map(np.exp, m.bias)), weights=tuple(map(np.exp, m.weights)))


def log_shares(x: Coded, e: Model) -> np.ndarray:
    """Natural log of each token's probability, by the factors of a model; of a tail class's
    words only the class's."""
    out = np.zeros(len(x.h))
    for lo in range(0, len(x.h), STEP):
        for level, c in enumerate(choices(x, lo, min(lo + STEP, len(x.h)), e)):
            z = _joined(e.weights[level], e.bias[level], c.rows, c.node, np.multiply)
            out[c.at] += np.log(z.reshape(-1)[_picked(z, c)]) - np.log(_row_sums(z))
    return out


def log_probs(x: Coded, m: Model) -> np.ndarray:
    return log_shares(x, factors(m))


def by_count(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sorted values: where each distinct one starts and how many there are, by falling
    number.  Most stand alone, so only the others are sorted."""
    start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
    n = np.diff(start, append=len(r))
    more = np.flatnonzero(n > 1)
    order = np.concatenate((more[np.argsort(-n[more], kind="stable")], np.flatnonzero(n == 1)))
    return start[order], n[order]


def sums_of(g: np.ndarray, of: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows ``g[of]`` in groups by falling size: the second rows of all groups that
    have one are added at once, which are the first of the sums, then the third ones and so on;
    a few large groups are left, whose other rows are summed up group by group."""
    sums = _rows(g, of[start])
    wide = np.searchsorted(-n, -np.arange(1, n[0] + 1))  # groups of more than so many rows
    k = 1
    while k < n[0] and wide[k - 1] > FEW:
        m = wide[k - 1]
        sums[:m] += _rows(g, of[start[:m] + k])
        k += 1
    for i in range(wide[k - 1] if k < n[0] else 0):
        rest = _rows(g, of[start[i] + k : start[i] + n[i]])
        sums[i] += np.ones(len(rest), g.dtype) @ rest
    return sums


def add_up(g: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows ``g`` in the order of ``r``: the distinct values of r, their rows' sums and
    counts."""
    start, n = by_count(r)
    order = np.argsort(start)
    return r[start[order]], sums_of(g, np.arange(len(r)), start, n)[order], n[order]


class Trainer:
    """AdaGrad on a copy of the model's hashed weights."""

    def __init__(self, m: Model, rate: float):
        self.rate = np.float32(rate)
        self.m = m._replace(weights=tuple(w.copy() for w in m.weights))
        self.squares = [np.zeros(len(w), np.float32) for w in m.weights]
        self.met = [np.zeros(len(w), np.float32) for w in m.weights]
        self.place = np.zeros(max(map(len, m.weights)), np.int32)  # of rows in a step

    def _step(self, level: int, c: Choice) -> None:
        """One gradient step.  The rows of weights that it needs are read and written once, and
        what lies between works on those."""
        r, n = np.concatenate(c.rows), len(c.at)
        order = np.argsort(r, kind="stable")
        start, times = by_count(r[order])
        at, weights = r[order[start]].astype(np.intp), self.m.weights[level]
        self.place[at] = np.arange(len(at))
        place = np.take(self.place, r, mode="clip")
        mine = _rows(weights, at)
        p = _joined(mine, self.m.bias[level], [place[i : i + n] for i in range(0, len(r), n)], c.node, np.add)
        np.exp(p, out=p)
        p *= (np.float32(1) / _row_sums(p))[:, None]
        p.reshape(-1)[_picked(p, c)] -= 1
        g = sums_of(p, order % n, start, times)
        self.met[level][at] += times
        squares = self.squares[level][at] + np.einsum("ij,ij->i", g, g)
        self.squares[level][at] = squares
        g *= (self.rate / np.sqrt(squares / np.float32(SPREAD) + np.float32(1)))[:, None]
        _set_rows(weights, at, np.subtract(mine, g, out=g))

    def learn(self, x: Coded) -> None:
        for lo in range(0, len(x.h), STEP):
            for level, c in enumerate(choices(x, lo, min(lo + STEP, len(x.h)), self.m)):
                self._step(level, c)
        for weights in self.m.weights:
            np.clip(weights, -LIMIT, LIMIT, out=weights)


def _batch(**columns: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def _count_words(limit: int = 4_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def merged():
            k = np.concatenate(keys)
            order = np.argsort(k, kind="stable")
            k = k[order]
            at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            return k[at], np.add.reduceat(np.concatenate(counts)[order], at)

        for b in K.pieces(batches):
            w = K.words(K.texts(b.column("text")))
            if not len(w.starts):
                continue
            k, c = np.unique(w.hashes(lower=True), return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > limit:
                k, c = merged()
                keys, counts, held = [k], [c], len(k)
                if held > limit // 2:
                    yield _batch(word=(K.signed(k), pa.int64()), c=(c, pa.int64()))
                    keys, counts, held = [], [], 0
        if held:
            k, c = merged()
            yield _batch(word=(K.signed(k), pa.int64()), c=(c, pa.int64()))

    return run


#: What tasks send of a slab: how often each row was met, and its weights (16 bits each); sums
#: of several tasks have the weights times that (32 bits each).
_WEIGHTS = "slab int, task int, met binary, weighted binary"


def _train(shared, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, any_ = Trainer(shared.value, rate), False
        for b in K.pieces(batches):
            if b.num_rows:
                any_ = True
                t.learn(coded(K.words(K.texts(b.column("text"))), t.m))
        task, slab = TaskContext.get().partitionId(), 0
        for met, weights in zip(t.met, t.m.weights, strict=True) if any_ else ():
            for i in range(0, len(met), SLAB):
                n, x = met[i : i + SLAB], weights[i : i + SLAB]
                if n.any():
                    yield _batch(slab=([slab], pa.int32()), task=([task], pa.int32()), met=([n.tobytes()], pa.binary()), weighted=([x.astype(np.float16).tobytes()], pa.binary()))
                slab += 1

    return run


def _sum_slabs(first: bool):
    def run(group: pa.Table) -> pa.Table:
        met = weighted = 0.0
        for r in group.sort_by("task").to_pylist():  # sums of floats depend on the order
            n = np.frombuffer(r["met"], np.float32).astype(np.float64)
            x = np.frombuffer(r["weighted"], np.float16 if first else np.float32).reshape(len(n), -1)
            met, weighted = met + n, weighted + (x * n[:, None] if first else x)
        raw = lambda v: pa.array([v.astype(np.float32).tobytes()], pa.binary())
        return pa.table({"slab": group.column("slab").slice(0, 1), "task": group.column("part").slice(0, 1), "met": raw(met), "weighted": raw(weighted)})

    return run


def _averaged(m: Model, made: DataFrame, parts: int) -> Model:
    """Weights averaged over ``parts`` tasks; a slab's sums are added up 64 tasks at a time."""
    first = True
    while first or parts > 1:
        made = made.withColumn("part", F.floor(F.col("task") / 64).cast("int")).groupBy("slab", "part").applyInArrow(_sum_slabs(first), _WEIGHTS)
        first, parts = False, -(-parts // 64)
    tables = tuple(w.copy() for w in m.weights)
    for r in made.toLocalIterator():  # MODEL_BYTES at most
        which, slab = divmod(r["slab"], len(tables[0]) // SLAB)
        n = np.frombuffer(r["met"], np.float32)
        x = np.frombuffer(r["weighted"], np.float32).reshape(SLAB, -1)
        part = tables[which][slab * SLAB : (slab + 1) * SLAB]
        part[n > 0] = x[n > 0] / n[n > 0, None]
    return m._replace(weights=tables)


def words_for(tokens: int) -> int:
    """The most words of a vocabulary for so many training tokens."""
    return min(MOST_WORDS, max(LEAST_WORDS, tokens // TOKENS_A_WORD))


def width_for(words: int) -> int:
    """The width of a tree for so many words and the end: a multiple of four."""
    width = 4
    while width**LEVELS < words + 1:
        width += 4
    return width


def rows_for(tokens: int, width: int) -> int:
    """Rows of each weight table for so many training tokens: a power of two."""
    wanted = 1 << max(0, (max(1, tokens) - 1) // TOKENS_A_ROW).bit_length()
    fitting = 1 << (MODEL_BYTES // (4 * (LEVELS * width + TAILS))).bit_length() - 1
    return max(LEAST_ROWS, min(MOST_ROWS, wanted, fitting))


def unigram_model(words: np.ndarray, counts: np.ndarray, ends: int, tails: list[tuple[int, int, int]], tokens: int = 0) -> Model:
    """The model without features: classes, groups and words by their training counts.
    ``tails`` are (tail class, tokens, distinct words) of all words but the vocabulary's.  Each
    tail class has room for one unseen word."""
    width = width_for(len(words))
    c = np.full(width**LEVELS, ADD)
    c[END] += ends
    c[1 : len(counts) + 1] += counts
    mass = np.full(TAILS, ADD)
    for t, n, distinct in tails:
        mass[t] += n + ADD * distinct
    masses = [c.reshape(width**level, width, -1).sum(2) for level in range(LEVELS)]
    masses[0] = np.concatenate((masses[0][0], mass))
    log = lambda x: np.log(x / x.sum(-1, keepdims=True)).astype(np.float32)
    order, rows = np.argsort(words), rows_for(tokens, width)
    weights = tuple(np.zeros((rows, width + TAILS * (level == 0)), np.float32) for level in range(LEVELS))
    return Model(words[order], (np.arange(len(words))[order] + 1).astype(np.int32), width, tuple(map(log, masses)), weights, mass)


def _kept(h: np.ndarray, c: Counts) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are kept words, and their counts."""
    if not len(c.kept):
        return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
    pos = place_of(h, c.kept)
    return pos >= 0, np.where(pos < 0, 0, c.counts[pos])


_SCORES = "doc_id long, row_key long, row_sub int, held_out boolean, n_tokens long, known long, log_counts double, model double"
_RARE = "row_key long, row_sub int, word long, times long"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, c = shared.value
        for b in K.pieces(batches):
            if not b.num_rows:
                continue
            x = coded(K.words(K.texts(b.column("text"))), e)
            there, count = _kept(x.h, c)
            end = x.h == END_HASH
            there |= end
            logs = np.where(there, np.log10(np.where(end, c.ends, count) + ADD), 0.0)
            tail = x.target < 0
            # A tail word's count is among the kept ones, or comes with the join.
            lp = log_shares(x, e) / math.log(10) + np.where(tail, logs - np.log10(e.tail_mass)[np.where(tail, tail_of(x.target), 0)], 0.0)
            add = lambda v: np.bincount(x.of, weights=v, minlength=b.num_rows)
            yield _batch(
                doc_id=(b.column("doc_id"), pa.int64()), row_key=(b.column("row_key"), pa.int64()), row_sub=(b.column("row_sub"), pa.int32()), held_out=(b.column("held_out"), pa.bool_()),
                n_tokens=(np.bincount(x.of, minlength=b.num_rows), pa.int64()), known=(add(there & (np.where(end, c.ends, count) > 0)).astype(np.int64), pa.int64()), log_counts=(add(logs), pa.float64()), model=(add(lp), pa.float64()),
            )

    return run


def _rare(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, c = shared.value
        for b in K.pieces(batches):
            w = K.words(K.texts(b.column("text")))
            h, doc = w.hashes(lower=True), w.doc()
            out = ~_kept(h, c)[0]
            h, doc = h[out], doc[out]
            order = np.argsort(h ^ K.mix(doc))  # one key; a word whose places a clash sets apart has two rows, which add up
            h, doc = h[order], doc[order]
            at = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))) if len(h) else np.zeros(0, np.int64)
            yield _batch(row_key=(np.asarray(b.column("row_key"))[doc[at]], pa.int64()), row_sub=(np.asarray(b.column("row_sub"))[doc[at]], pa.int32()), word=(K.signed(h[at]), pa.int64()), times=(np.diff(np.append(at, len(h))), pa.int64()))

    return run


def _most_frequent(counts: DataFrame, most: int):
    """Words by falling count, those of equal count by their hash, and how many of them are the
    vocabulary.  Both are all words above a limit that a histogram of the counts gives: the
    vocabulary has at most ``most``, the others are kept while there are at most KEPT_WORDS."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}  # 16 rows a doubling
    total, low, vocabulary = 0, None, 0
    for x in sorted(sizes, reverse=True):
        total += sizes[x]
        if total > max(most, KEPT_WORDS):
            break
        low, vocabulary = x, total if total <= most else vocabulary
    kept = counts.where(F.lit(False) if low is None else level >= low)
    return kept.toPandas().sort_values(["c", "word"], ascending=[False, True]), vocabulary


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def score_documents(docs: DataFrame, rounds: int = ROUNDS, part_tokens: int | None = None) -> DataFrame:
    """Train on the documents that are not held out, score all: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score, score.

    A document is held out if crc32 of its doc_id as text (null: '') is a multiple of 10.
    Words are lower-cased (A-Z); every text, also a null or empty one, has an end token.
    base_score is the smoothed unigram log10 probability, score the model's.

    Ties: words of equal counts are all in the vocabulary or none is; if so many words share
    the highest count that they don't fit, all words are in tail classes.  Repeated rows count and are scored each; a very long text is one part's
    work.  Without training documents every token is unknown.  An empty table gives an empty
    one; other columns are ignored.
    """
    return _scored(docs, rounds, part_tokens)[0]


def _scored(docs: DataFrame, rounds: int, part_tokens: int | None) -> tuple[DataFrame, Model, Counts]:
    spark = prepare(docs.sparkSession)
    d = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    d = d.withColumns({"row_key": F.xxhash64("doc_id", "text"), "row_sub": F.hash("text", "doc_id"), "held_out": held_out(F.col("doc_id"))})
    train = d.where("not held_out")
    counts = stored(train.select("text").mapInArrow(_count_words(), "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    ends = train.count()
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = (total["n"] or 0) + ends, total["v"] + (ends > 0)
    top, size = _most_frequent(counts, words_for(n))
    words, often = top["word"].to_numpy(np.int64).view(K.U64), top["c"].to_numpy(np.int64)
    order = np.argsort(words)
    c = Counts(n, v, ends, words[order], often[order])
    # Tail classes: all words by hash, less the vocabulary's.
    by_tail = counts.groupBy(F.pmod(F.shiftrightunsigned("word", 7), F.lit(TAILS)).cast("int").alias("t")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"))
    tails = {r["t"]: [r["n"], r["v"]] for r in by_tail.collect()}  # TAILS rows
    for t, k in zip(tail_class(words[:size]).tolist(), often[:size].tolist(), strict=True):
        tails[t][0] -= k
        tails[t][1] -= 1
    m = unigram_model(words[:size], often[:size], ends, [(t, *x) for t, x in tails.items()], n)
    part_tokens = part_tokens or PART_TOKENS_A_ROW * len(m.weights[0])
    for r in range(rounds if n else 0):
        # Parts of equal size by a hash, in the order of another: the same in every run.
        parts = max(1, -(-n // (rounds * part_tokens)))
        share = train.where(F.pmod(F.xxhash64("row_key"), F.lit(rounds)) == r).select("row_key", "row_sub", "text")
        share = share.repartitionById(parts, F.pmod(F.xxhash64("row_sub", "row_key"), F.lit(parts)).cast("int")).sortWithinPartitions("row_key", "row_sub", "text").select("text")
        shared = spark.sparkContext.broadcast(m)  # the hashed tables, MODEL_BYTES at most, and words
        m = _averaged(m, share.mapInArrow(_train(shared, RATES[min(r, len(RATES) - 1)]), _WEIGHTS), parts)
        shared.unpersist()

    shared = spark.sparkContext.broadcast((factors(m), c))
    key = ["row_key", "row_sub"]
    scores = stored(d.mapInArrow(_score(shared), _SCORES), "lm-scores")
    rare = d.select(*key, "text").mapInArrow(_rare(shared), _RARE)
    rare = rare.join(counts, "word", "left").select(*key, "times", F.coalesce("c", F.lit(0)).alias("c"))
    # None of these words is in the vocabulary: each is a tail token as well.
    rare = rare.groupBy(*key).agg(F.sum(F.col("times") * F.log10(F.col("c") + ADD)).alias("rare_logs"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    # Equal rows share a key, and what was summed over all of them.
    copies = scores.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    all_ = scores.join(copies, key).join(rare, key, "left")
    logs = F.coalesce(F.col("rare_logs") / F.col("copies"), F.lit(0.0))
    whole = n + ADD * (v + 1)
    scored = all_.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce((F.col("rare_known") / F.col("copies")).cast("long"), F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_counts") + logs - F.col("n_tokens") * math.log10(whole)).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )
    return scored, m, c
