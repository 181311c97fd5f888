import re
from collections import defaultdict
from itertools import product

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm.mixing import fit_budget, knapsack, mix_sources, proportional, take_mix, targets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets_reshare_the_excess():
    t = targets([("a", 10), ("b", 100), (None, 1000)])
    assert t["a"] == 30.0 and t["b"] == 300.0 and t[None] == 780.0
    assert sum(t.values()) == 1110
    t = targets([("b", 100), ("a", 100), (None, 100)])
    assert t == {"a": 50.0, "b": 100.0, None: 150.0}
    assert targets([]) == {} and targets([("a", 0)]) == {"a": 0.0}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 3)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(0, 80))
def test_small_budgets_are_fitted_as_near_as_possible(items, budget):
    lengths, counts = np.array([x[0] for x in items]), np.array([x[1] for x in items])
    take = fit_budget(lengths, counts, budget)
    assert (take >= 0).all() and (take <= counts).all()
    got = int((take * lengths).sum())
    start = proportional(lengths, counts, budget)
    assert (start * lengths).sum() <= budget and budget - (start * lengths).sum() <= max(lengths) or (start == counts)[lengths > 0].all()
    start = np.zeros(len(counts), int) if 3 * max(lengths) >= budget else start
    reach = {sum(int(length) * n for length, n in zip(lengths, pick, strict=True)) for pick in product(*[range(s, c + 1) for s, c in zip(start, counts, strict=True)])}
    assert abs(got - budget) <= min(abs(x - budget) for x in reach)


def test_large_budget_is_exact():
    rng = np.random.default_rng(1)
    lengths = np.arange(1, 2000)
    counts = rng.integers(1, 50, len(lengths))
    for share in (0.1, 0.5, 0.9):
        budget = int((lengths * counts).sum() * share) + 7
        assert int((fit_budget(lengths, counts, budget) * lengths).sum()) == budget


def test_samples_are_not_skewed():
    """Words left for the knapsack may be many; long and short texts are taken alike."""
    rng = np.random.default_rng(3)
    lengths, counts = np.unique(np.minimum(rng.lognormal(5.5, 1.2, 20000).astype(int) + 1, 60000), return_counts=True)
    pool = (lengths * counts).sum() / counts.sum()
    for share in (0.003, 0.02, 0.3, 0.77, 0.98):
        budget = int((lengths * counts).sum() * share)
        take = fit_budget(lengths, counts, budget)
        assert (take * lengths).sum() == budget and (take <= counts).all()
        assert abs((take * lengths).sum() / take.sum() / pool - 1) < 0.05, share


def test_knapsack_of_many_words():
    rng = np.random.default_rng(5)
    lengths = np.unique(rng.integers(1000, 90000, 300))
    free = rng.integers(1, 4, len(lengths))
    left = 1_234_567
    take = knapsack(lengths, free, left)
    assert (take * lengths).sum() == left and (take <= free).all() and (take >= 0).all()
    assert (knapsack(np.array([6, 9, 15]), np.array([5, 5, 5]), 100) * [6, 9, 15]).sum() == 99


def test_nearest_total_from_above():
    lengths, counts = np.array([120, 180_000]), np.array([2, 1])
    take = fit_budget(lengths, counts, 178_994)
    assert take.tolist() == [0, 1]
    assert fit_budget(np.array([120]), np.array([5]), 170).tolist() == [1] and fit_budget(np.array([120]), np.array([5]), 190).tolist() == [2]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(1, 200))
def test_knapsack_is_nearest(items, left):
    lengths, free = np.array([x[0] for x in items]), np.array([x[1] for x in items])
    take = knapsack(lengths, free, left)
    assert (take >= 0).all() and (take <= free).all()
    reach = {sum(int(length) * n for length, n in zip(lengths, pick, strict=True)) for pick in product(*[range(c + 1) for c in free])}
    assert abs(int((take * lengths).sum()) - left) == min(abs(x - left) for x in reach)


def test_one_text_of_ten_million_words():
    import tracemalloc

    rng = np.random.default_rng(2)
    lengths = np.unique(np.concatenate((rng.integers(1, 20_000, 400) * 2, [10_000_000])))
    counts = rng.integers(1, 9, len(lengths))
    budget = int((lengths * counts).sum() * 0.6) // 2 * 2
    tracemalloc.start()
    take = fit_budget(lengths, counts, budget)
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert int((take * lengths).sum()) == budget and (take <= counts).all()


def test_mix(docs, corpus, empty):
    rows = mix_sources(docs).collect()
    assert len(rows) == len(corpus)
    size = defaultdict(int)
    for r in corpus:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want = targets(list(size.items()))
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.copies <= 3 and r.taken == r.size * r.copies
        taken[r.target, r.source_size] += r.taken
    near = defaultdict(float)
    for s, t in want.items():
        near[t, size[s]] += t
    sizes = defaultdict(list)
    for r in rows:
        sizes[r.target, r.source_size].append(r.size)
    for k, t in near.items():
        # No choice of copies comes nearer, but for a word of rounding.
        reach = 1
        for n in sizes[k]:
            for _ in range(3):
                reach |= reach << n
        best = min(abs(x - t) for x in range(reach.bit_length()) if reach >> x & 1)
        assert abs(taken[k] - t) <= best + 1
    again = mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    whole = take_mix(docs)
    assert whole.columns == docs.columns and whole.count() == sum(r.copies for r in rows)
    assert mix_sources(empty).count() == 0


def test_repeats_fill_what_single_documents_cannot(spark):
    rows = [(0, "w " * 9000, "a")] + [(i, "v " * 10, "a") for i in range(1, 201)] + [(900, "u " * 6000, "b")]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    a = [r for r in out if r.source_size == 11000]
    assert a[0].target < 9000 and abs(sum(r.taken for r in a) - a[0].target) <= 5 and max(r.copies for r in a) <= 3


def test_one_hot_length(spark):
    rows = [(i, "same text here", "a") for i in range(3000)] + [(9000 + i, "w " * 50, "b") for i in range(100)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    got = {r.source_size: (r.s, r.target) for r in out.groupBy("source_size", "target").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "s").collect()}
    for s, t in got.values():
        assert abs(s - t) <= 50
