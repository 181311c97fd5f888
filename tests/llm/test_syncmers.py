import hashlib
import random
from collections import Counter

import numpy as np
import xxhash

from seqloom.llm import kernel as K
from seqloom.llm import syncmers as S

import pyarrow as pa


def brute(rows):
    h = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() + 2**63) % 2**64
    key = lambda r: (r[0] is None, -(r[0] or 0), h(r[1] or ""), r[1] or "")
    order = sorted(rows, key=key)
    out = []
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        t, u = a[1] or "", b[1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        fp = lambda x: S.sketches(K.words(K.texts(pa.array([x], pa.string()))), S.K_WORDS, S.S_WORDS)[0]
        f, e, n = fp(t), fp(edited), fp(u)
        out.append((a[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), S.as_text(f), S.as_text(e), brute_likeness(f, e), brute_likeness(f, n)))
    return sorted(out, key=str)


def brute_likeness(a, b):
    """Longest chain of equal anchors by the table of common subsequences of paired anchors."""
    def numbered(x):
        seen = Counter()
        out = []
        for h in x.hashes.tolist():
            out.append((h, seen[h]))
            seen[h] += 1
        return out

    x, y = numbered(a), numbered(b)
    both = set(x) & set(y)
    x, y = [v for v in x if v in both], [v for v in y if v in both]
    if len(x) > 700:
        assert x == y
        row = [len(x)]
    else:
        row = [0] * (len(y) + 1)
        for v in x:
            last = 0
            for j, u in enumerate(y):
                last, row[j + 1] = row[j + 1], last + 1 if v == u else max(row[j + 1], row[j])
    total = len(a.hashes) + len(b.hashes)
    return row[-1] / (total - row[-1]) if total else 1.0


def test_matches_brute_force(docs, corpus):
    for blocks in (1, 4, 40):
        got = sorted((tuple(r) for r in S.edited_fingerprints(docs, blocks=blocks).collect()), key=str)
        assert got == brute(corpus)


def test_anchors_do_not_depend_on_context():
    text = " ".join(f"t{i}" for i in range(60))
    w = lambda x: K.words(K.texts(pa.array([x], pa.string())))
    a = S.closed_syncmers(w(text))
    b = S.closed_syncmers(w("lead in words " + text + " and a tail"))
    inner = {(p + 3, h) for p, h in zip(a[0].tolist(), a[1].tolist(), strict=True)}
    assert inner <= set(zip(b[0].tolist(), b[1].tolist(), strict=True)) and len(inner) > 15
    x, y = S.sketches(w(text), 5, 2)[0], S.sketches(w("lead in words " + text), 5, 2)[0]
    shared = S.matches(x, y)
    assert shared and all(y.positions[q] - x.positions[p] == 3 for p, q in shared)


def test_matching_keeps_to_the_order():
    rng = random.Random(3)
    w = lambda x: K.words(K.texts(pa.array([x], pa.string())))
    a, b = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(120)) for c in "ab")
    x, y = S.sketches(w(f"{a} {b}"), 8, 2)[0], S.sketches(w(f"{b} {a}"), 8, 2)[0]
    assert 0.3 < S.likeness(x, y) < 0.6 and S.likeness(x, x) == 1.0 and S.likeness(x, S.sketches(w(a), 8, 2)[0]) < 0.6
    assert S.likeness(x, y) == brute_likeness(x, y)
    again = S.from_text(S.as_text(x))
    assert S.likeness(again, x) == 1.0 and again.positions.tolist() == x.positions.tolist() and S.from_text("").hashes.size == 0
    long = S.sketches(w(" ".join(f"{a} {i}" for i in range(50))), 8, 2)[0]
    assert len(long.hashes) > 1000 and S.likeness(long, long) == 1.0


def test_a_hot_id_takes_several_blocks(spark):
    rng = random.Random(4)
    rows = [(7, " ".join(f"w{rng.randrange(999)}" for _ in range(20))) for _ in range(150)] + [(i, f"a b {i}") for i in range(60)] + [(None, f"n {i}") for i in range(80)]
    rows += [(7, "same text")] * 20
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (3, 12):
        assert sorted((tuple(r) for r in S.edited_fingerprints(d, blocks=n).collect()), key=str) == brute(rows)
    b = S.Blocks([1, 7, 7, 7, 9], 4)
    of = {int(x) for x in b.of(pa.array([7] * 100, pa.int64()), np.array([rng.randrange(-(2**63), 2**63) for _ in range(100)]))}
    assert len(of) == 3 and max(of) - min(of) == 2 and b.n == 12 - 1


def test_equal_texts_equal_fingerprints_and_likeness(docs, spark, empty):
    f = {}
    for r in S.fingerprints(docs).collect():
        f.setdefault(r.doc_id, r.fingerprint)
    assert f[5] == f[75] == f[76] and f[70] == f[71] == f[72] == "" and f[73] != ""
    one = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    r = S.edited_fingerprints(one).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert S.edited_fingerprints(empty).count() == 0 and S.fingerprints(empty).count() == 0


def test_closed_syncmer_definition():
    w = K.words(K.texts(pa.array([" ".join(f"q{i % 13}{i % 5}" for i in range(80))], pa.string())))
    at, _ = S.closed_syncmers(w, 5, 2)
    h = w.hashes()
    inner = K.spans_hash(h, np.arange(79), np.arange(2, 81), S._INNER)
    want = [i for i in range(76) if min(inner[i : i + 4]) in (inner[i], inner[i + 3])]
    assert at.tolist() == want
