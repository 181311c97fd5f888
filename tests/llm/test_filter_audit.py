"""Filter audit against counting document by document, in every order."""

from itertools import permutations

import pytest

from seqloom.llm.filter_audit import audit_filters, interactions

LETTERS = "ABCDE"
SPACE = "\x20\t\n\x0b\x0c\r"


def words(text):
    for c in SPACE[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(docs, labels):
    """docs (doc_id, text, part), labels (doc_id, quality, toxic) -> rows by (part, order, step)."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _ in labels if i is not None and q == 1}
    bad = {i for i, _, x in labels if i is not None and x == 1}
    rows = []
    for i, t, part in docs:
        t = t or ""
        w = words(t)
        fails = (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t])
        rows.append((part or "", fails, i in good, i in bad))
    out = {}
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = dict.fromkeys(LETTERS, 0)
        for order in map("".join, permutations(LETTERS)):
            gone = [False] * len(mine)
            for step, x in enumerate(order, 1):
                f = LETTERS.index(x)
                hit = [r[1][f] for r in mine]
                now = [h and not g for h, g in zip(hit, gone, strict=True)]
                gone = [g or h for g, h in zip(gone, hit, strict=True)]
                total[x] += sum(now)
                out[part, order, step] = [
                    len(mine) - sum(gone), sum(now), sum(hit) - sum(now), sum(r[1][f] and sum(r[1]) == 1 for r in mine),
                    sum(n and r[2] for n, r in zip(now, mine, strict=True)), sum(n and r[3] for n, r in zip(now, mine, strict=True)),
                ]
        for order in map("".join, permutations(LETTERS)):
            for step, x in enumerate(order, 1):
                out[part, order, step].append(total[x])
    return out


def got(df):
    rows = df.collect()
    assert len({tuple(r[:3]) for r in rows}) == len(rows)
    return {tuple(r[:3]): list(r[3:]) for r in rows}


LABELS = "doc_id long, quality int, toxic int, good string, n int"


def test_against_brute_force(spark):
    many = " ".join(f"w{i}" for i in range(120))
    docs = [
        (1, many, "en"), (2, many, "de"), (3, many, "en"), (3, many, "en"), (None, many, "en"), (4, None, "en"), (5, "", None), (6, " \t\n", ""), (7, "a " * 150, "de"),
        (8, many.upper(), "en"), (9, many + " #", "fr"), (10, many + "\x0b|\x0c", "fr"), (11, "Ä É ABC", "fr"), (-1, many, "zz"), (12, "x y", "en"), (12, "x y z", "en"), (13, " ".join(["nb"] * 130), "en"),
        (14, " ".join(f"w{i % 80}" for i in range(100)), "en"), (15, " ".join(f"w{i % 79}" for i in range(100)), "en"), (16, "A" + "b" * 9, "x"), (17, "AA" + "b" * 9, "x"), (18, "word " * 30000, "en"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, 0), (4, None, 1), (None, 1, 1), (8, 1, None), (9, 1, 0), (99, 1, 1), (12, 1, 0)]
    d = spark.createDataFrame([(i, t, p, "x", 1, 2) for i, t, p in docs], "doc_id long, text string, lang string, mask string, digest int, part int").repartition(3)
    m = spark.createDataFrame([(*r, "x", 3) for r in labels], LABELS)
    assert got(audit_filters(d, m)) == brute(docs, labels)


def test_the_corpus(spark, docs, corpus):
    m = spark.createDataFrame([(i, i % 2, int(i % 5 == 0), "x", 1) for i in range(40)], LABELS)
    assert got(audit_filters(docs, m)) == brute([(r[0], r[1], r[2]) for r in corpus], [(i, i % 2, int(i % 5 == 0)) for i in range(40)])


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], LABELS)
    assert audit_filters(empty, none).count() == 0
    assert {r["good_lost"] for r in audit_filters(docs, none).select("good_lost").collect()} == {0}


@pytest.mark.parametrize("letters", ["A", "PQ", "XYZ"])
def test_any_number_of_filters(spark, letters):
    rows = [("p", m, m % 2 == 0, m % 3 == 0) for m in range(1 << len(letters)) for _ in range(m + 1)]
    out = {(r["filter_order"], r["step"]): r for r in interactions(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"), letters).collect()}
    for order in map("".join, permutations(letters)):
        left = rows
        for step, x in enumerate(order, 1):
            bit = 1 << letters.index(x)
            hit = [r for r in left if r[1] & bit]
            left = [r for r in left if not r[1] & bit]
            r = out[order, step]
            assert (r["kept"], r["removed"], r["good_lost"], r["toxic_lost"]) == (len(left), len(hit), sum(h[2] for h in hit), sum(h[3] for h in hit))


def test_stays_in_the_jvm_and_joins_no_crosswise(spark, docs):
    plan = audit_filters(docs, spark.createDataFrame([(1, 1, 1, "", 1)], LABELS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
