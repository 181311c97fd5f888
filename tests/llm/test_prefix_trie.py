"""The trie of conversations against one that is built in memory."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from seqloom.llm.prefix_trie import own_turns, ordered_turns, prefix_trie, shared_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, k1 int, node long, w long"


def sequences(rows, share=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode(), text or ""))
    own = {c: [(r, t, x) for _, _, r, t, x in sorted(v)] for c, v in own.items()}
    if not share:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(seqs):
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(x[:2] for x in s[:d]), []).append((c, len(s), len(s[d - 1][2]) if d else 0))
    kids = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, m in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(m) - 1) * m[0][2]
    out = set()
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c, n, _ in m if n == len(k))))
        above = min(c for c, _, _ in nodes[k[:-1]]) if k else None
        out.add((min(c for c, _, _ in m), len(k), above, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA).repartition(parts)


def same(df, want):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want


def made(rng, ids, words=3, turns=7):
    return [(c, t, rng.choice(["user", "assistant"]), f"w{rng.randrange(words)}é") for c in ids for t in range(rng.randint(1, turns))]


def test_shared_heads(spark):
    rng = random.Random(2)
    rows = made(rng, [*range(0, 40), *range(95, 130), *range(300, 320), *range(401, 420), *range(-30, 0), 9_000_000_000_000_000_123])
    rng.shuffle(rows)
    same(shared_prefix_trie(frame(spark, rows)), brute(sequences(rows)))


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, None, "", "a"), (1, None, "", "a"), (1, 2, "user", "b"), (2, 5, "user", ""), (2, 5, "assistant", "z"), (2, 5, "user", "y"), (2, 5, "assistant", "z")]
    rows += [(3, t, "u", f"{t}") for t in range(300)] + [(4, t, "u", f"{t}") for t in range(300)] + [(5, t, "r" * 80 + str(t % 2), "t" * 90 + str(t)) for t in (1, 1, 1)]
    rows += [(6, 1, "r" * 80 + "b", "a"), (6, 1, "r" * 80 + "a", "b"), (7, 0, "u", "x" * 100_000)]
    rows += [(0, 0, "u", "0"), (0, 1, "u", "1")]
    same(shared_prefix_trie(frame(spark, rows)), brute(sequences(rows)))


def test_copies_as_they_are(spark):
    """Many copies, a conversation within another, and a long shared beginning."""
    rows = [(c, t, "u", f"t{t}") for c in range(50) for t in range(4)] + [(c, t, "u", f"t{t}") for c in range(50, 60) for t in range(2)]
    rows += [(70, t, "u", f"t{t}") for t in range(9)] + [(71, t, "u", f"t{min(t, 7)}") for t in range(9)]
    same(prefix_trie(*own_turns(ordered_turns(frame(spark, rows)))), brute(sequences(rows, share=False)))


def test_one_class_only(spark):
    rows = [(c, t, "u", "same") for c in (5, 3, 9) for t in range(3)]
    same(prefix_trie(*own_turns(ordered_turns(frame(spark, rows)))), brute(sequences(rows, share=False)))
    # Every conversation borrows from an absent one, and none has own turns left.
    rows = [(c, 0, "u", "x") for c in range(101, 160) if zlib.crc32(str(c).encode()) % 6]
    same(shared_prefix_trie(frame(spark, rows)), brute(sequences(rows)))


def test_digests_of_many_ids(spark, monkeypatch):
    import seqloom.llm.prefix_trie as P

    monkeypatch.setattr(P, "IDS_A_ROW", 7)
    rows = [(c, 0, "u", f"t{c % 2}") for c in range(-50, 150)]
    same(prefix_trie(*own_turns(ordered_turns(frame(spark, rows)))), brute(sequences(rows, share=False)))


def test_one_conversation_over_many_tasks(spark):
    rows = [(8, t, "u", f"{t * 7919 % 1000}") for t in range(2000)] + [(9, t, "u", "z") for t in range(5)]
    turns = ordered_turns(frame(spark, rows, 8))
    got = sorted((r["conv_id"], r["pos"], r["before"]) for r in turns.collect())
    want, before = [], 0
    for t in range(2000):
        want.append((8, t, before))
        before += len(f"{t * 7919 % 1000}")
    assert got == want + [(9, t, t) for t in range(5)]


def test_empty_table(spark):
    out = shared_prefix_trie(frame(spark, []))
    assert out.count() == 0
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", [5, 6])
def test_random(spark, seed):
    rng = random.Random(seed)
    rows = made(rng, rng.sample(range(0, 1000), 150), words=2, turns=9)
    rows += rows[:40]
    same(shared_prefix_trie(frame(spark, rows, 5)), brute(sequences(rows)))
