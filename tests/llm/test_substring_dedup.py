import hashlib
import random
import re
from collections import Counter

import pytest

from seqloom.llm import substring_dedup as S
from seqloom.llm.substring_dedup import remove_repeated_substrings, strip_repeated_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    all_ = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    counts = Counter(tuple(w[i : i + window]) for _, w in all_ for i in range(len(w) - window + 1))
    out = []
    for d, w in all_:
        gone = set()
        for i in range(len(w) - window + 1):
            if counts[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,gram", [(35, 8), (10, 3), (5, 5), (3, 1)])
def test_matches_brute_force(docs, corpus, window, gram):
    got = remove_repeated_substrings(docs, window, gram).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == brute(corpus, window)
    for r in got:
        assert sum(x.end - x.start for x in r.removed) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.removed, r.removed[1:], strict=False))


def test_periodic_text_repeats_itself(spark):
    text = "a b c d e " * 12
    rows = [(1, text), (2, "q " + " ".join(map(str, range(100))))]
    got = {r.doc_id: r.n_removed for r in remove_repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 35).collect()}
    assert got == {1: 60, 2: 0}


def test_equal_ids_with_other_texts_do_not_mix(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (1, b), (2, a)]
    got = sorted(r.n_removed for r in remove_repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string"), 35).collect())
    assert got == [0, 40, 40]


def test_strip_keeps_rows_and_columns(docs, corpus):
    out = strip_repeated_substrings(docs, 35)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == len(corpus)
    expected = sorted((str(d), n - gone) for d, n, gone, _ in brute(corpus, 35))
    assert sorted((str(r.doc_id), len(WORD.findall(r.text or ""))) for r in rows) == expected
    assert all(r.n_chars == len(r.text or "") for r in rows)


def test_empty_table(empty):
    assert remove_repeated_substrings(empty).count() == 0
    assert strip_repeated_substrings(empty).count() == 0


def test_many_copies_of_a_row_stay_linear(spark):
    """Each copy gets the row's repeated windows once, not once for every copy."""
    rng = random.Random(6)
    text = " ".join(f"w{rng.randrange(9**6)}" for _ in range(120))
    other = text[: len(text) // 2] + " " + " ".join(f"v{rng.randrange(9**6)}" for _ in range(80))
    rows = [(1, text)] * 1000 + [(2, other)]
    d = S._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    sizes = [r.n for r in S._with_hits(d, 35, 8).where("doc_id = 1").selectExpr("size(hits) AS n").collect()]
    assert len(sizes) == 1000 and max(sizes) <= 86
    out = S.remove_repeated_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.n_removed == 120 for r in out if r.doc_id == 1) and {r.n_removed for r in out if r.doc_id == 2} <= set(range(40, 70))
