"""Filter interaction audit: what each filter removes, in every order of the filters.

Every document gets a mask of the filters it fails; documents are counted by part and mask.  A
subset-zeta transform turns a part's mask counts into the survivors of every subset of
filters: with z[T] the documents whose failures all lie in T, those that pass all filters of
S are z[not S].  An order of filters is a chain of subsets, so each of its steps is the
difference between two neighbouring subsets, for all documents and for the labelled ones.

Masks are counted before they are shuffled, so a part of any size costs 2**filters rows a
task.  Everything is built-in functions.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import columns, stored

#: White space between words, for a regular expression and for trimming.
_GAP, _BLANKS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
DUPLICATE = "E"


def text_failures(text: Column) -> dict[str, Column]:
    """Filters that a text fails by itself: A few words, B repeated words, C capitals, D symbols."""
    inner = F.btrim(text, F.lit(_BLANKS))
    words = F.split(inner, _GAP)
    n = F.when(inner == "", 0).otherwise(F.size(words))
    return {
        "A": n < 100,
        "B": (inner != "") & (100 * F.size(F.array_distinct(words)) < 80 * n),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 10 * F.char_length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def failure_masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row a document: part, mask (bit i: it fails the i-th filter), good, toxic."""
    d = columns(docs, "doc_id", "text", part).toDF("doc_id", "text", "part")
    text = F.coalesce("text", F.lit(""))
    own = text_failures(text)
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(own.values())), F.lit(0))
    d = stored(d.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"), mask.alias("mask"), F.sha2(text, 256).alias("digest")), "filter-masks")
    # A document is a duplicate unless it is the first of its text; the pair of both is no hot key.
    first = d.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").withColumn("first", F.lit(True))
    marks = columns(labels, "doc_id", "quality", "toxic").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("bad"))
    d = d.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return d.select("part", (F.col("mask") + F.when(copy, 1 << len(own)).otherwise(0)).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("bad", F.lit(False)).alias("toxic"))


def zeta(counts: Column, bits: int) -> Column:
    """Sums over all subsets of each index of an array of 2**bits longs, one bit at a time."""

    def add(sums: Column, bit: Column) -> Column:
        flag = F.call_function("shiftleft", F.lit(1), bit)
        return F.transform(sums, lambda x, i: x + F.when(i.bitwiseAND(flag) != 0, F.get(sums, i.bitwiseXOR(flag))).otherwise(F.lit(0).cast("long")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), counts, add)


def interactions(masks: DataFrame, letters: str) -> DataFrame:
    """(part, mask, good, toxic) rows to one row a part, order of the filters and step."""
    bits = len(letters)
    whole = (1 << bits) - 1
    counted = masks.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # At most 2**bits rows a part from here on.
    by_mask = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("m"))

    def survivors(name: str) -> Column:
        dense = F.transform(F.sequence(F.lit(0), F.lit(whole)), lambda i: F.coalesce(F.try_element_at("m", i)[name], F.lit(0).cast("long")))
        return zeta(dense, bits).alias(name)

    z = by_mask.select("part", *[survivors(x) for x in ("n", "good", "toxic")])
    orders = F.explode(F.lit(["".join(p) for p in permutations(letters)])).alias("filter_order")
    steps = F.explode(F.sequence(F.lit(1), F.lit(bits))).alias("step")
    z = z.select("*", orders).select("*", steps)
    place = lambda letter: F.call_function("shiftleft", F.lit(1), F.instr(F.lit(letters), letter) - 1)
    earlier = F.aggregate(F.sequence(F.lit(1), F.lit(bits)), F.lit(0), lambda a, i: a + F.when(i < F.col("step"), place(F.substring(F.col("filter_order"), i, F.lit(1)))).otherwise(0))
    z = z.select("*", place(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))).alias("bit"), earlier.alias("before"))
    passed = lambda name, removed: F.get(name, F.lit(whole).bitwiseXOR(removed))
    none, bit, before = F.lit(0), F.col("bit"), F.col("before")
    after = before.bitwiseOR(bit)
    lost = lambda name: passed(name, before) - passed(name, after)
    weights = F.lit([factorial(k) * factorial(bits - 1 - k) for k in range(bits)])
    others = F.filter(F.sequence(F.lit(0), F.lit(whole)), lambda s: s.bitwiseAND(bit) == 0)
    share = F.aggregate(others, F.lit(0).cast("long"), lambda a, s: a + F.get(weights, F.bit_count(s)) * (passed("n", s) - passed("n", s.bitwiseOR(bit))))
    failing = passed("n", none) - passed("n", bit)
    alone = passed("n", F.lit(whole).bitwiseXOR(bit)) - passed("n", F.lit(whole))
    return z.select(
        "part",
        "filter_order",
        "step",
        passed("n", after).alias("kept"),
        lost("n").alias("removed"),
        (failing - lost("n")).alias("redundant"),
        alone.alias("unique_fails"),
        lost("good").alias("good_lost"),
        lost("toxic").alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """For each part, each of the 120 orders of the filters A to E and each step: documents kept
    after it and removed by it, those that fail its filter but went earlier (redundant), those
    that fail no other (unique_fails), labelled ones that it removes, and the filter's removals
    summed over all orders (shapley).

    A null text is empty; a null part is ''.  A document is a duplicate (E) if a smaller doc_id
    has the same text, wherever it is and whether removed or not: of rows equal in doc_id and
    text none is the other's duplicate, and a null doc_id is no one's.  Labels may repeat a
    doc_id: one row with quality 1 or toxic 1 is enough; documents without labels count as
    neither.  Repeated documents count each.  An empty table has no parts, so no rows.  Very long
    texts are one row's work.  Other columns, of any name, are ignored.
    """
    return interactions(failure_masks(docs, labels, part), "ABCD" + DUPLICATE)
