"""Vectorised word kernels over Arrow text batches (numpy only, no Spark).

A *word* is a maximal run of bytes outside 0x20 and 0x09-0x0D, which for UTF-8 is the
same as the pattern ``[^\\x20\\x09-\\x0D]+`` on code points.  Hashes are 64 bits wide:
polynomial (Rabin-Karp) sums modulo 2**64 over randomised byte values, finished with a
mixing step.  All functions take whole texts; their memory is a small multiple of the
bytes of one batch.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_SEED = 0x5EED_10F_77
_powers: dict[int, list[np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: a bijection on 64-bit values."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_SEED))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, kept for the next call."""
    base |= 1
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            out = np.empty(size, U64)
            out[0] = 1
            done = 1
            while done < size:
                step = U64(pow(b, done, 1 << 64))
                out[done : 2 * done] = out[:done] * step
                done *= 2
            both.append(out)
        if size <= 1 << 20:
            _powers[base] = both
        have = both
    return have[0][:n], have[1][:n]


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp hash of values[starts:ends] for each pair of bounds, from one prefix sum."""
    if len(starts) == 0:
        return np.empty(0, U64)
    up, down = powers(base, len(values) + 1)
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))


class Texts(NamedTuple):
    """The bytes of a batch of texts, without gaps; text i is data[offsets[i]:offsets[i+1]]."""

    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Words of a batch: bounds in data, and for each text its first word (n + 1 entries)."""

    texts: Texts
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        return spans_hash((_BYTE_LOWER if lower else _BYTE)[self.texts.data], self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.texts.data[self.starts[i] : self.ends[i]].tobytes()


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """Bytes and offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    raw = column.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None and len(column) else np.empty(0, np.uint8)
    return Texts(data, offsets - offsets[0])


#: Bytes of text that are worked on at once; a longer text is worked on alone.
PIECE_BYTES = 1 << 20


def pieces(batches: Iterable[pa.RecordBatch], *columns: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about PIECE_BYTES of the named text columns ("text" if none
    is named), so that memory does not follow the length of the texts that meet in a batch."""
    for b in batches:
        total = np.zeros(b.num_rows, np.int64)
        for name in columns or ("text",):
            total += np.asarray(pc.binary_length(b.column(name)).fill_null(0), np.int64)
        share = np.cumsum(total) // PIECE_BYTES
        starts = np.flatnonzero(np.concatenate(([True], share[1:] != share[:-1]))) if len(share) else []
        for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
            yield b.slice(lo, hi - lo)


def words(t: Texts) -> Words:
    n = len(t.data)
    if n == 0:
        none = np.empty(0, np.int64)
        return Words(t, none, none, np.zeros(len(t.offsets), np.int64))
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    inside = ~SPACE[t.data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begin)
    return Words(t, starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, t.offsets))


def windows(first: np.ndarray, size: int) -> np.ndarray:
    """Indices of the words at which a window of ``size`` words of one text starts."""
    n = int(first[-1])
    ok = np.zeros(n + 1, np.int64)
    ends = np.maximum(first[1:] - size + 1, first[:-1])
    np.add.at(ok, first[:-1], 1)
    np.add.at(ok, ends, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of x[i : i + size] for each full window, by doubling."""
    have, out = 1, x
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in the union of the half-open spans."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (half open) of the maximal runs of True."""
    d = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def per_text_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive bounds (n + 1 bounds, n sums)."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return np.diff(total[bounds])


def signed(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return x.view(np.int64)
