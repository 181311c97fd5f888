"""Secret scans: patterns of known kinds, and sliding-window entropy for the unknown ones.

Candidates are long runs of the characters that keys are made of.  Over every window of
``WINDOW`` characters of a candidate the Shannon entropy follows from the sum of c * log2(c)
over the counts c of its characters.  That sum is kept incrementally: a character that enters
or leaves changes it by the step between two neighbouring counts.  The steps are whole numbers
(fixed point), so the sums are exact wherever a candidate is cut.  A window is high if all its
characters are of one class, it has both letters and digits, and its entropy reaches the
class's bound; high windows that overlap or touch are one span.  Candidates that an allow-list
names (identifiers, slugs and paths of words, placeholders, public checksums, embedded data)
are passed over.

Texts are scanned where they are read; nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from ._spark import columns, prepare

#: Kinds by pattern, in their order within equal starts, and how long a match (or its group) must be.
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # runs are maximal, so the bound can be part of the pattern
LEAST_VALUE, LEAST_ACCESS = 8, 16
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 24
CANDIDATE = re.compile(rb"[A-Za-z0-9+/=_-]{%d,}" % WINDOW)


class CharClass(NamedTuple):
    """Characters of one alphabet, and the entropy (bits) from which a window of them counts."""

    name: str
    characters: bytes
    bound: float


_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
#: A window of random characters has 3.5 bits on average in hexadecimal, 4.0 in 36 characters and
#: 4.3 in 64; one of English words run together has 3.4 to 3.8.
CLASSES = (
    CharClass("hexadecimal", b"ABCDEFabcdef" + _DIGITS, 3.0),
    CharClass("upper", _UPPER + _DIGITS, 3.7),
    CharClass("base64", _UPPER + _LOWER + _DIGITS + b"+/=_-", 4.0),
)

#: What a whole candidate may be, and what it may hold, without being a secret.
ALLOWED_WHOLE = (
    rb"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    rb"=*(?:[A-Za-z]+|[0-9]{1,4})(?:[-_/+=]+(?:[A-Za-z]+|[0-9]{1,4}))*[-_/=]*",  # words and small numbers
)
ALLOWED_PART = (
    rb"(?i:example|sample|dummy|placeholder|change_?me|redacted|your[-_]?(?:api|key|token|secret))",
    rb"(?i:abcdefgh|qwertyui|01234567|12345678)",
    rb"([A-Za-z0-9])\1{7}",
    rb"\A/*sha(?:1|256|384|512)-",
)
#: What may stand before a candidate: data in the text itself is no key.
ALLOWED_BEFORE = (rb";base64,",)
_BEFORE = 16

_POINT = 1 << 32
_SUMS = np.array([round(k * np.log2(k) * _POINT) if k else 0 for k in range(WINDOW + 1)], np.int64)
_STEPS = np.diff(_SUMS)
#: Characters whose windows are worked out together; a longer candidate is cut, with overlap.
BLOCK = 1 << 18


def sum_bound(entropy: float) -> int:
    """The largest sum of c * log2(c) (fixed point) at which a window has that entropy."""
    return round(WINDOW * (np.log2(WINDOW) - entropy) * _POINT)


def window_sums(chars: np.ndarray, piece: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each position, the sum of c * log2(c) over the window of WINDOW characters that ends
    there; windows do not leave their piece (``piece``: its number, ``first``: its start)."""
    n = len(chars)
    at, key = np.arange(n), piece.astype(np.int64) * 256 + chars
    order = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[order] = at
    sorted_ = key[order] * (n + 1) + order
    # Equal characters in the window before one enters, and from one on until it leaves.
    before = place - np.searchsorted(sorted_, key * (n + 1) + np.maximum(at - WINDOW + 1, 0))
    onward = np.searchsorted(sorted_, key * (n + 1) + np.minimum(at + WINDOW, n)) - place
    change = _STEPS[before]
    leaves = np.flatnonzero(at - first >= WINDOW)
    change[leaves] -= _STEPS[onward[leaves - WINDOW] - 1]
    total = np.cumsum(change)
    return total - (total[first] - change[first])


def high_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, classes: tuple[CharClass, ...] = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """Spans of ``data`` that the high windows of the candidates cover, overlapping ones merged."""
    spans: list[np.ndarray] = []
    pieces = [(lo, min(lo + BLOCK, e)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) for lo in range(s, max(s + 1, e - WINDOW + 1), BLOCK - WINDOW + 1)]
    held: list[tuple[int, int]] = []
    size = 0
    for p in [*pieces, None]:
        if p is not None:
            held.append(p)
            size += p[1] - p[0]
        if held and (p is None or size >= BLOCK):
            spans.append(_high(data, np.array(held), classes))
            held, size = [], 0
    found = np.concatenate(spans) if spans else np.empty(0, np.int64)
    if not len(found):
        return found, found
    found = np.unique(found)  # starts of high windows
    new = np.flatnonzero(np.concatenate(([True], np.diff(found) > WINDOW)))
    return found[new], found[np.append(new[1:], len(found)) - 1] + WINDOW


def _high(data: np.ndarray, pieces: np.ndarray, classes: tuple[CharClass, ...]) -> np.ndarray:
    """Starts of the high windows of some pieces (rows of start and end)."""
    lengths = pieces[:, 1] - pieces[:, 0]
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    piece = np.repeat(np.arange(len(pieces)), lengths)
    first = begin[piece]
    at = np.arange(len(piece))
    origin = pieces[piece, 0] + at - first
    chars = data[origin]
    sums = window_sums(chars, piece, first)
    whole = at - first >= WINDOW - 1
    high = np.zeros(len(at), bool)

    def inside(table: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(table[chars])))
        return total[at + 1] - total[np.maximum(at + 1 - WINDOW, 0)]

    def table(characters: bytes) -> np.ndarray:
        t = np.zeros(256, bool)
        t[np.frombuffer(characters, np.uint8)] = True
        return t

    mixed = (inside(table(_DIGITS)) > 0) & (inside(table(_UPPER + _LOWER)) > 0)
    for c in classes:
        high |= (inside(table(c.characters)) == WINDOW) & (sums <= sum_bound(c.bound))
    return origin[high & mixed & whole] - WINDOW + 1


class AllowList(NamedTuple):
    whole: re.Pattern
    part: re.Pattern
    before: re.Pattern

    def names(self, buffer: bytes, start: int, end: int) -> bool:
        return bool(self.whole.fullmatch(buffer, start, end) or self.part.search(buffer[start:end]) or self.before.search(buffer[max(0, start - _BEFORE) : start]))


def allow_list(whole: tuple[bytes, ...] = ALLOWED_WHOLE, part: tuple[bytes, ...] = ALLOWED_PART, before: tuple[bytes, ...] = ALLOWED_BEFORE) -> AllowList:
    either = lambda xs: re.compile(b"|".join(b"(?:%s)" % x for x in xs) or rb"(?!)")
    return AllowList(either(whole), either(part), re.compile(b"(?:%s)\\Z" % b"|".join(before) if before else rb"(?!)"))


def scan(texts: list[bytes], allowed: AllowList) -> list[tuple[int, int, int, int]]:
    """(text, kind, start, end) of all secrets of some texts, in bytes, by text, start and kind.
    No pattern holds a line break, so the texts are scanned together, one break between two."""
    buffer = b"\n".join(texts)
    found = [(0, *m.span()) for m in ASSIGN.finditer(buffer) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(1, *m.span()) for m in ACCESS.finditer(buffer) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(2, *m.span()) for m in HEX.finditer(buffer)]
    runs = np.array([m.span() for m in CANDIDATE.finditer(buffer) if not allowed.names(buffer, *m.span())], np.int64).reshape(-1, 2)
    starts, ends = high_windows(np.frombuffer(buffer, np.uint8), runs[:, 0], runs[:, 1])
    if len(starts):
        # A span within one of a known kind tells nothing new.
        known = sorted(x[1:] for x in found)
        begin = np.array([x[0] for x in known] or [len(buffer)])
        reach = np.maximum.accumulate(np.array([x[1] for x in known] or [0]))
        at = np.searchsorted(begin, starts, "right") - 1
        new = (at < 0) | (reach[np.maximum(at, 0)] < ends)
        found += [(3, s, e) for s, e in zip(starts[new].tolist(), ends[new].tolist(), strict=True)]
    if not found:
        return []
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    kind, start, end = np.array(found, np.int64).T
    of = np.searchsorted(first, start, "right") - 1
    order = np.lexsort((end, kind, start, of))
    return list(zip(*(x[order].tolist() for x in (of, kind, start - first[of], end - first[of])), strict=True))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def _find(allowed: AllowList):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in K.pieces(batches):
            texts = b.column("text").fill_null("").cast(pa.large_binary()).to_pylist()
            spans: list[list[dict]] = [[] for _ in texts]
            last, inner = -1, np.empty(0, np.int64)
            for i, kind, start, end in scan(texts, allowed):
                if i != last:  # bytes that do not begin a code point
                    last, inner = i, np.flatnonzero((np.frombuffer(texts[i], np.uint8) & 0xC0) == 0x80)
                start, end = start - int(np.searchsorted(inner, start)), end - int(np.searchsorted(inner, end))
                spans[i].append({"kind": KINDS[kind], "start": start, "end": end})
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])

    return run


def find_secrets(docs: DataFrame, allowed: AllowList | None = None) -> DataFrame:
    """doc_id and its spans (kind, start, end in code points, end exclusive), by start and kind.

    Kinds: an assignment to a name like password, an access key, a long hexadecimal number, and
    ``entropy``: high windows outside of those.  Matches of a pattern do not overlap and are
    taken from the left; too short ones go, but what they cover is not searched again.

    A null or empty text has no spans.  Repeated rows have theirs each.  A very long text is
    one row's work: its windows are worked out in blocks, so memory is a small multiple of the
    text.  An empty table gives an empty one; other columns are ignored.
    """
    prepare(docs.sparkSession)
    d = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(_find(allowed or allow_list()), "doc_id long, spans array<struct<kind string, start long, end long>>")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digest(found: DataFrame) -> DataFrame:
    """Counts of the known kinds, the digest of their spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    known = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(listed(known), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
