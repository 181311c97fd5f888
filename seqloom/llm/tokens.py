"""Token ids of whole texts, by a public tokenizer read from a file.

The tokenizer used here drops white space and never joins two words, nor a letter with the
punctuation after it, so the ids of a text are those of such units in turn.  Most units of a
corpus are met again and again: each worker keeps the ids of those it has seen (a bounded
number) in a hash table that is searched for a whole batch at once, and hands only new ones
to the tokenizers library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import kernel as K

#: Units whose ids a worker remembers; beyond it, it forgets all and starts again.
REMEMBERED_UNITS = 500_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Second bytes of the letters U+00C0 to U+00FF, after a byte 0xC3.
_LATIN = np.zeros(256, bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
#: Units that are one pre-token and that no normalizer changes once they are lower case.
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def units(t: K.Texts) -> K.Words:
    """Words, cut further between a letter and ASCII punctuation after it.  Words that hold
    ``<|``, as special tokens do, stay whole."""
    w = K.words(t)
    data = t.data
    if len(data) < 2 or not len(w.starts):
        return w
    letter = _LETTER[data]
    letter[1:] |= _LATIN[data[1:]] & (data[:-1] == 0xC3)
    cut = np.zeros(len(data), bool)
    cut[1:] = letter[:-1] & _PUNCTUATION[data[1:]]
    cut[w.starts] = False
    for at in np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)).tolist():
        i = np.searchsorted(w.starts, at, side="right") - 1
        cut[w.starts[i] : w.ends[i]] = False
    at = np.flatnonzero(cut)
    if not len(at):
        return w
    starts = np.sort(np.concatenate((w.starts, at)))
    ends = np.sort(np.concatenate((w.ends, at)))
    return K.Words(t, starts, ends, np.searchsorted(starts, t.offsets))


def special_units(w: K.Words) -> np.ndarray:
    """The units that hold ``<|``: special tokens are met in their exact case only."""
    data = w.texts.data
    at = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    if not len(at):
        return at
    i = np.searchsorted(w.starts, at, side="right") - 1
    return np.unique(i[at + 1 < w.ends[i]])


class Table:
    """A hash table from non-zero 64-bit keys to row numbers, for arrays of keys."""

    def __init__(self, capacity: int):
        size = 1 << max(10, int(2 * capacity - 1).bit_length())
        self.mask, self.keys, self.rows = size - 1, np.zeros(size, K.U64), np.zeros(size, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> K.U64(17)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or -1."""
        out, slot, left = np.full(len(keys), -1, np.int64), self._slot(keys), np.arange(len(keys))
        while len(left):
            there = self.keys[slot]
            hit = there == keys[left]
            out[left[hit]] = self.rows[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, rows: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]  # of those that want one slot the last gets it
            mine = self.keys[slot] == keys
            self.rows[slot[mine]] = rows[mine]
            keys, rows, slot = keys[~mine], rows[~mine], (slot[~mine] + 1) & self.mask


class WordEncoder:
    """Ids of texts by a tokenizer whose ids of a text are those of its units in turn."""

    def __init__(self, spec: str, remembered: int = REMEMBERED_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_str(spec), remembered
        self.model = self.tokenizer.model
        # The tokenizer's own name of each byte, for units that go to its model directly.
        named = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.names = {c: named(c)[0][0] for c in map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)])}
        self._forget()

    def _forget(self) -> None:
        self.table = Table(self.limit)
        self.known = 0
        self.start = np.zeros(self.limit, np.int64)
        self.size = np.zeros(self.limit, np.int32)
        self.pool = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _ids(self, unit: bytes) -> list[int]:
        text = unit.decode("utf-8", "replace")
        low = text.lower()
        if _PLAIN.fullmatch(low):
            name = low if low.isascii() else "".join(map(self.names.__getitem__, low))
            return [t.id for t in self.model.tokenize(name)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, keys: np.ndarray, found: list[bytes]) -> None:
        ids = [self._ids(u) for u in found]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.array([i for x in ids for i in x], np.int32)
        at, end = self.known, self.used + len(flat)
        while end > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        self.start[at : at + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.size[at : at + len(keys)] = sizes
        self.pool[self.used : end] = flat
        self.table.add(keys, np.arange(at, at + len(keys)))
        self.known, self.used = at + len(keys), end

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the bounds of each text's (n + 1 of them)."""
        w = units(K.texts(column))
        if not len(w.starts):
            return np.empty(0, np.int32), np.zeros(len(w.first), np.int64)
        keys = w.hashes(lower=True)
        special = special_units(w)
        if len(special):
            keys[special] = K.Words(w.texts, w.starts[special], w.ends[special], w.first).hashes()
        keys |= K.U64(1)
        rows = self.table.find(keys)
        new = np.flatnonzero(rows < 0)
        if len(new):
            fresh, place = np.unique(keys[new], return_index=True)
            if self.known + len(fresh) > self.limit:
                # Start again with the units of this batch, however many they are.
                fresh, place = np.unique(keys, return_index=True)
                self.limit = max(self.limit, len(fresh))
                self._forget()
                new, rows = np.arange(len(keys)), np.full(len(keys), -1, np.int64)
            self._learn(fresh, [w.word(i) for i in new[place].tolist()])
            rows[new] = self.table.find(keys[new])
        size = self.size[rows].astype(np.int64)
        ends = np.cumsum(size)
        gather = np.repeat(self.start[rows] - (ends - size), size) + np.arange(ends[-1])
        bounds = np.concatenate(([0], ends))[w.first]
        return self.pool[gather], bounds


_encoders: dict[int, WordEncoder] = {}


def encoder(spec: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file's content."""
    key = hash(spec)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]


def append_id(ids: np.ndarray, bounds: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text."""
    if end_id is None:
        return ids, bounds
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, np.int32)
    keep = np.ones(len(out), bool)
    new = bounds + np.arange(n + 1)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new


def encoded(batches: Iterator[pa.RecordBatch], spec: str, end_id: int | None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    e = encoder(spec)
    for b in K.pieces(batches):
        if b.num_rows:
            yield b, *append_id(*e.encode(b.column("text")), end_id)
