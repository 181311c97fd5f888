import random

import numpy as np
import pyarrow as pa
import pytest

from seqloom.llm import jaccard_join as J
from seqloom.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    s = [(r[0], shingles(r[1], n)) for r in rows]
    group = list(range(len(s)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, (a, x) in enumerate(s):
        for j in range(i):
            b, y = s[j]
            if a is not None and b is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                group[find(i)] = find(j)
    least = {}
    for i, (a, _) in enumerate(s):
        if a is not None:
            least[find(i)] = min(least.get(find(i), a), a)
    return sorted(((a, len(x), None if a is None else (least[find(i)] if x else a)) for i, (a, x) in enumerate(s)), key=str)


@pytest.mark.parametrize("ngram,percent,subparts", [(3, 90, 3), (5, 80, 2), (1, 60, 3)])
def test_components_match_brute_force(docs, corpus, ngram, percent, subparts):
    got = J.jaccard_components(docs, ngram, percent, subparts).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(corpus, ngram, percent)


def test_hub_far_from_other_copies(spark):
    """Copies that link only by way of an original, and pairs that no hub settles."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = [(100, " ".join(base))]
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(120)] = f"e{rng.random()}"
        rows.append((i, " ".join(copy)))
        twin = list(copy)
        twin[rng.randrange(120)] = f"t{i}"
        rows.append((200 + i, " ".join(twin)))
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 3, 90)


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(4)
    for _ in range(150):
        n = int(rng.integers(1, 400))
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        drop = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
        b = a[drop:]
        add = int(rng.integers(0, max(1, n * (100 - percent) // 150) + 1))
        b = np.concatenate((b, rng.integers(1, 2**63, add).astype(np.uint64)))
        a, b = np.unique(a), np.unique(b)
        if not len(b) or 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        s, sig = J.signatures(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]), J.Bands(percent), int(rng.integers(2, 4)))
        assert set(sig[s == 0].tolist()) & set(sig[s == 1].tolist())


def test_difference_bound_is_exact():
    for percent in (60, 80, 90):
        for total in range(2, 200):
            k = J.max_difference(total, percent)
            ok = lambda d: 100 * (total - d) / 2 >= percent * (total + d) / 2
            assert ok(k) and not ok(k + 1)


def test_copies_of_rows_are_one_set(spark):
    """A link between two sets is one, however many copies of their rows there are."""
    a = [f"w{i}" for i in range(200)]
    b = a[:100] + ["new"] + a[101:]
    rows = [(1, " ".join(a))] * 40 + [(2, " ".join(b))] * 30
    got = J.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 70 and all(r.links == 1 and r.component_id == 1 for r in got)


def test_sets_that_share_a_name_are_told_apart(spark, monkeypatch):
    """As if first hashes were short: names then clash, and second hashes tell sets apart."""
    real = J.set_hashes
    g, bounds = J.shingle_sets(pa.array(["a b c d", "x y z u", "a b c d"]), 3)
    first, second = real(g, bounds)
    assert first[0] == first[2] != first[1] and second[0] == second[2] != second[1]
    names = J.set_names(g, bounds, first[:1])
    assert names[0] == names[2] and names[0] not in (first[0], names[1]) and names[1] == first[1]


def test_keep_one_of_each(docs, corpus, empty):
    out = J.keep_one_of_each(docs)
    assert out.columns == docs.columns
    want = brute(corpus, 5, 80)
    groups = {c for d, n, c in want if n and d is not None}
    lone = sum(1 for d, n, _ in want if not n or d is None)
    rows = out.collect()
    assert len(rows) == len(groups) + lone
    assert groups <= {r.doc_id for r in rows}
    assert J.keep_one_of_each(empty).count() == 0 and J.jaccard_components(empty).count() == 0


def test_large_sets_that_share_signatures_only_are_not_verified(spark, monkeypatch):
    """Texts of thousands of words with lines in common: only links, and what can't be told from
    them, get as far as the join with texts; no link is lost."""
    rng = random.Random(12)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    lines = [make(5) for _ in range(60)]
    rows = []
    for i in range(36):
        w = make(rng.randint(3000, 3600))
        for line in rng.sample(lines, 50):
            at = rng.randrange(len(w))
            w[at:at] = line
        rows.append((i, " ".join(w)))
        if i % 6 == 0:
            for at in rng.sample(range(len(w)), 60):
                w[at] = f"e{rng.random()}"
            rows.append((100 + i, " ".join([*w, *make(40)])))
    tried = []
    real = J.verified
    monkeypatch.setattr(J, "verified", lambda pairs, *rest: tried.append(pairs.count()) or real(pairs, *rest))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = J.jaccard_components(d, 5, 80, 2).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, 5, 80)
    assert sum(tried) == 6


@pytest.mark.parametrize("percent", [30, 60, 80, 90])
def test_wide_sketches_bound_the_difference(percent):
    rng = np.random.default_rng(6)
    bits = J.sketch_bits(percent)
    for _ in range(40):
        n = int(rng.integers(1100, 9000))
        a = rng.integers(1, 2**63, n).astype(np.uint64)
        b = np.concatenate((a[int(rng.integers(0, n // 2)) :], rng.integers(1, 2**63, int(rng.integers(0, n))).astype(np.uint64)))
        far = rng.integers(1, 2**63, n).astype(np.uint64)
        a, b, far = np.unique(a), np.unique(b), np.unique(far)
        g, bounds = np.concatenate((a, b, far)), np.cumsum([0, len(a), len(b), len(far)])
        x, y, z = J.wide_sketches(g, bounds, bits)
        assert len(x) * 8 >= n * bits and J.differing_bits(x, z) > J.max_difference(2 * n, percent)
        if y is not None:
            assert J.differing_bits(x, y) == J.differing_bits(y, x) <= len(np.setxor1d(a, b))
    assert J.wide_sketches(np.arange(5, dtype=np.uint64), np.array([0, 0, 5]), bits) == [None, None]


def test_written_tables_leave_no_shuffle_files(spark):
    """They went only when the driver's JVM happened to collect its garbage."""
    from pyspark.sql import functions as F

    from seqloom.llm._spark import stored

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return {b for b in blocks.mkString(" ").split() if b.startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffles(), spark.conf.get(key)
    d = spark.range(5000).groupBy((F.col("id") % 70).alias("k")).count().repartition(5, "k")
    counts = stored(d, "counts")
    assert not shuffles() - before and spark.conf.get(key) == setting
    assert counts.count() == 70


def test_groups_with_one_smallest_id_keep_a_row_each(spark):
    a, b = [" ".join(f"{x}{i}" for i in range(60)) for x in "ab"]
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (1, a)]
    out = J.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(1, a), (1, b)]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(9)
    names = rng.sample(range(1, 10**6), 400)
    edges = [(names[i], names[i + 1]) for i in range(0, 199)] + [(names[200], names[i]) for i in range(201, 300)] + [(names[300], names[301]), (names[301], names[302]), (names[302], names[300]), (names[5], names[5])]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    for part in (names[:200], names[200:300], names[300:303]):
        roots = {got[n] for n in part}
        assert len(roots) == 1 and roots <= set(part)
    assert len(got) == 303
