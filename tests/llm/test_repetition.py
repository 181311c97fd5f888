import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm.repetition import MAX_COVERED, MAX_LONGEST, MIN_REPEAT, keep_good, longest_repeats, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_longest(w):
    n, out = len(w), [0] * len(w)
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=24), min_size=1, max_size=5))
def test_longest_repeats(texts):
    ids = np.array([x for t in texts for x in t], np.int64)
    first = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    assert longest_repeats(ids, first).tolist() == [x for t in texts for x in brute_longest(t)]


def test_counts_match_brute_force(docs, corpus):
    got = sorted((tuple(r)[:6] + (r.base_failed,) for r in quality_rules(docs).collect()), key=str)
    want = []
    for d, text, *_ in corpus:
        t = text or ""
        w = WORD.findall(t)
        at = {}
        for i in range(len(w) - 2):
            at.setdefault(tuple(w[i : i + 3]), []).append(i)
        again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        want.append((d, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(again), failed))
    assert got == sorted(want, key=str)


def test_method_rejects_long_repeats_and_keeps_clean(spark):
    rng = random.Random(1)
    fresh = lambda n: [f"u{rng.random()}" for _ in range(n)]
    clean = fresh(300)
    block = fresh(40)
    rows = [(1, " ".join(clean)), (2, " ".join(fresh(60) + block + fresh(20) + block)), (3, " ".join(fresh(900) + block + fresh(20) + block))]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].longest_repeat == 0
    assert not got[2].kept and got[2].longest_repeat == 40 and got[2].covered_words == 80
    assert got[3].kept and got[3].longest_repeat == 40
    assert (MIN_REPEAT, MAX_COVERED, MAX_LONGEST) == (8, 0.3, 0.2)


def test_keep_good_keeps_columns(docs, empty):
    out = keep_good(docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()
    assert keep_good(empty).count() == 0 and quality_rules(empty).count() == 0
