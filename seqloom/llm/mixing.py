"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact word length.  Every document is taken as often
as the source's target holds the whole source.  Of the rest of the target each stretch of
lengths first gives its share: a systematic sample along the lengths, which stays below the
target by less than the longest document, however large the source.  A bounded-knapsack
dynamic programme over the documents that are left then fills the remaining words, exactly
where lengths allow it, else as near as they allow, which may be above the target.  A document
is repeated beyond that only if the others can't fill the target.  Which documents of a length are taken follows a seeded hash order, found by
counting hash buckets, so no length, however common, is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import numbered, prepare, stored

WEIGHTS, MAX_REPEATS, SEED = (1, 2, 3), 3, 17
#: Starts that are tried for the systematic sample.
STARTS = 64
#: Samples that are tried, each with one longest length more left for the knapsack.
SLACKS = 4
#: Hash buckets of the documents of a length: at least so many, and one for so many documents.
LEAST_BUCKETS, DOCS_A_BUCKET = 256, 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = WEIGHTS, limit: int = MAX_REPEATS) -> dict[str | None, float]:
    """Target words of each source: all words shared by weight (sources by code point, null
    last, weights in turn), none above ``limit`` times its size, the excess shared again."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(ordered)}
    cap = {s: float(limit * n) for s, n in ordered}
    left, open_, out = float(sum(n for _, n in ordered)), [s for s, _ in ordered], {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > cap[s]]
        for s in above or open_:
            out[s] = cap[s] if above else left * weight[s] / total
        if not above:
            break
        left -= sum(cap[s] for s in above)
        open_ = [s for s in open_ if s not in out]
    return out


def proportional(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Items of each length by a systematic sample, so that every stretch of lengths gives
    its share and the words stay at or below ``budget``.

    The expected number of items, summed up from the longest length down, is cut at whole
    numbers shifted by a start.  From start 0 what is missing is less than the longest
    length; of the other starts the one that comes nearest from below is taken.
    """
    total = int((lengths * counts).sum())
    counts = np.where(lengths > 0, counts, 0)
    if budget >= total:
        return counts
    down = np.argsort(-lengths, kind="stable")
    size, have = lengths[down], counts[down]
    expected = np.concatenate(([0.0], np.cumsum(have, dtype=np.float64) * (budget / total)))
    best, most = np.zeros(len(size), np.int64), 0
    for start in range(STARTS):
        take = np.minimum(np.diff(np.floor(expected + start / STARTS)).astype(np.int64), have)
        words = int((take * size).sum())
        if most < words <= budget:
            best, most = take, words
    out = np.zeros(len(lengths), np.int64)
    out[down] = best
    return out


def _reach(steps: Sequence[int], cap: int) -> int:
    """The sums of some of the steps, up to ``cap``, as the bits of a number."""
    bits, mask = 1, (1 << (cap + 1)) - 1
    for s in steps:
        bits |= (bits << s) & mask
    return bits


def _flags(bits: int, n: int) -> np.ndarray:
    """The lowest n bits, one by one."""
    return np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n].view(bool)


def _chosen(steps: Sequence[int], goal: int) -> list[int]:
    """Indices of steps that sum up to ``goal``, which some of them do.  Halves are tried against
    each other, so nothing is kept of the way there: one bit and one byte for each sum."""
    out, left = [], [(0, len(steps), goal)]
    while left:
        lo, hi, g = left.pop()
        if not g:
            continue
        if hi - lo == 1:
            out.append(lo)
            continue
        mid = (lo + hi) // 2
        first, second = (_flags(_reach(steps[x:y], g), g + 1) for x, y in ((lo, mid), (mid, hi)))
        at = int(np.argmax(first & second[::-1]))
        left += [(lo, mid, at), (mid, hi, g - at)]
    return out


def knapsack(lengths: np.ndarray, free: np.ndarray, left: int, seed: int = SEED) -> np.ndarray:
    """Items of each length, at most ``free``, whose words come nearest to ``left``, from either
    side (of two equally near totals the lower one).

    The dynamic programme is a set of sums, one bit each, to which item groups are offered:
    in a seeded order, in which common lengths tend to be early, one item of each length, then
    two, four and so on, until ``left`` is reached or all are offered.  If it is missed from
    below, sums above it that are nearer are looked for in the same way.  Lengths that share
    a divisor are counted in units of it.
    """
    take = np.zeros(len(lengths), np.int64)
    if left <= 0:
        return take
    below, best = _filled(lengths, free, left, left, seed)
    miss = left - best
    if miss:
        above, total = _filled(lengths, free, left, left + miss - 1, seed)
        if total > left:
            return above
    return below


def _filled(lengths: np.ndarray, free: np.ndarray, left: int, cap: int, seed: int) -> tuple[np.ndarray, int]:
    """Items whose words are ``left``, else the smallest sum above it and up to ``cap``, else the
    largest below; and that sum."""
    take = np.zeros(len(lengths), np.int64)
    usable = np.flatnonzero((lengths > 0) & (lengths <= cap) & (free > 0))
    if not len(usable):
        return take, 0
    unit = int(np.gcd.reduce(lengths[usable]))
    bound, goal = cap // unit, left // unit if left % unit == 0 else -1
    order = usable[np.argsort(np.random.default_rng(seed).exponential(size=len(usable)) / free[usable], kind="stable")]
    groups: list[tuple[int, int]] = []
    steps: list[int] = []
    bits, mask, room, n = 1, (1 << (bound + 1)) - 1, free.copy(), 1
    done = False
    while len(order) and not done:
        for i in order.tolist():
            m = int(min(n, room[i]))
            step = int(lengths[i]) // unit * m
            room[i] -= m
            if step > bound:
                continue
            grown = bits | (bits << step) & mask
            if grown != bits:
                bits = grown
                groups.append((i, m))
                steps.append(step)
                if goal >= 0 and bits >> goal & 1:
                    done = True
                    break
        n *= 2
        order = order[(room[order] > 0) & (lengths[order] // unit * np.minimum(n, room[order]) <= bound)]
    over = bits >> (left // unit + 1)
    if done:
        at = goal
    elif over:
        at = left // unit + (over & -over).bit_length()
    else:
        at = bits.bit_length() - 1
    for k in _chosen(steps, at):
        i, m = groups[k]
        take[i] += m
    return take, at * unit


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, passes: int = 1) -> np.ndarray:
    """How many items of each length to take so that the total comes near to ``budget``: a
    systematic sample, then the knapsack for all that is left; items are taken a second time
    (up to ``passes`` times) only where single ones miss the budget.

    If what the sample leaves can't be filled to the word, samples that leave one longest
    length more each are tried as well, down to none, and the nearest total is kept: the
    nearest of all where the knapsack had the whole budget.
    """
    if budget <= 0 or not int((lengths * counts).sum()):
        return np.zeros(len(lengths), np.int64)
    longest, best, miss = int(lengths[counts > 0].max()), None, None
    for slack in range(SLACKS):
        sample = proportional(lengths, counts, max(0, budget - slack * longest))
        left = budget - int((sample * lengths).sum())
        for k in range(1, passes + 1):
            take = sample + knapsack(lengths, k * counts - sample, left)
            off = abs(budget - int((take * lengths).sum()))
            if miss is None or off < miss:
                best, miss = take, off
            if not miss:
                break
        if not miss or slack * longest >= budget:
            break
    return best


def _plan(group: pa.Table) -> pa.Table:
    """For each length: every document's copies (times), and how many get one more (extra)."""
    order = np.argsort(group.column("size").to_numpy(), kind="stable")  # the same in every run
    group = group.take(pa.array(order))
    size, n = group.column("size").to_numpy(), group.column("n").to_numpy()
    target = group.column("target")[0].as_py()
    whole = int((size * n).sum())
    times = min(int(target // whole), MAX_REPEATS) if whole else 0
    take = fit_budget(size, n, round(target - times * whole), MAX_REPEATS - times)
    return group.append_column("times", pa.array(times + take // n, pa.int32())).append_column("extra", pa.array(take % n, pa.int64()))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, copies int,
    taken (size times copies).

    Size is the number of words ``[^\\x20\\x09-\\x0D]+`` of the whole text (null: 0).  No
    document is taken more than three times.  The choice depends on seed, doc_id and text
    alone, so reruns agree; of equal rows the same number is taken in every run.  Documents
    without words are taken as often as their source's whole passes.  Repeated rows are
    documents of their own; null sources are one source, the last; very long texts count like
    others; an empty table gives an empty one.  Other columns are ignored.

    The words of each source, one row a source, are summed up on the driver: sources and
    their weights are a setting of the mix.
    """
    d, made = _mixed(docs, weights, seed, whole=False)
    return made.select(F.col(d[0]).cast("long").alias("doc_id"), "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def take_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with all their columns, whatever
    their names.  Cases are those of ``mix_sources``."""
    _, made = _mixed(docs, weights, seed, whole=True)
    kept = [f"c{i}" for i in range(len(docs.columns))]
    times = made.where("copies > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return times.select(*kept).toDF(*docs.columns)


def _mixed(docs: DataFrame, weights: Sequence[int], seed: int, whole: bool) -> tuple[list[str], DataFrame]:
    """The names of doc_id, text and source among numbered columns, and the numbered rows, or
    of them only doc_id, with size, source_size, target and copies."""
    spark = prepare(docs.sparkSession)
    d, (doc_id, text, source) = numbered(docs, "doc_id", "text", "source")
    sized = d.withColumns({
        "size": F.expr(f"CAST(regexp_count(coalesce({text}, ''), r'{WORD}') AS BIGINT)"),
        "h": F.xxhash64(F.lit(seed), doc_id, text),
        "h2": F.hash(text, doc_id),
        "no_source": F.col(source).isNull(),
        "source": F.coalesce(F.col(source), F.lit("")),
    }).withColumn("bucket", F.pmod("h", F.lit(max(LEAST_BUCKETS, d.count() // DOCS_A_BUCKET))).cast("int"))
    if not whole:
        sized = sized.select(doc_id, "size", "h", "h2", "no_source", "source", "bucket")
    keys = ["no_source", "source", "size"]
    counted = stored(sized.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("m")), "mix-counts")
    sums = counted.groupBy("no_source", "source").agg(F.sum(F.col("size") * F.col("m")).alias("words")).collect()
    words = {None if r["no_source"] else r["source"]: r["words"] for r in sums}
    goal = targets(list(words.items()), weights)
    goals = spark.createDataFrame([(s is None, s or "", n, float(goal[s])) for s, n in words.items()], "no_source boolean, source string, source_size long, target double")
    lengths = counted.groupBy(*keys).agg(F.sum("m").alias("n")).join(goals, ["no_source", "source"]).select("no_source", "source", "size", "n", "source_size", "target")
    plan = lengths.groupBy("no_source", "source").applyInArrow(_plan, "no_source boolean, source string, size long, n long, source_size long, target double, times int, extra long")
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0)))
    parts = counted.join(plan, keys).select(*keys, "bucket", "before", "source_size", "target", "times", "extra")
    rank = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy("h", "h2"))
    made = sized.join(parts, [*keys, "bucket"]).withColumn("copies", F.col("times") + (F.col("before") + rank <= F.col("extra")).cast("int"))
    return [doc_id, text, source], made
