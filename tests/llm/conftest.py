import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, node long"


def words(rng, n, size=400):
    return [f"w{min(int(rng.expovariate(0.02)), size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, ...) with nulls, empty and very long texts, ties, repeated rows, copies,
    near copies, shared passages, and columns with clashing names."""
    rng = random.Random(5)
    passage = " ".join(words(rng, 60))
    rows = []
    for i in range(60):
        text = " ".join(words(rng, rng.randint(1, 200)))
        if i % 6 == 0:
            text = f"{text} {passage}\n{' '.join(words(rng, 20))}"
        if i % 7 == 0:
            text += "\n" + "\n".join(["Same line here."] * 6)
        rows.append((i, text))
    near = words(rng, 150)
    for i in range(60, 70):
        copy = list(near)
        copy[rng.randrange(150)] = f"edit{i}"
        rows.append((i, " ".join(copy)))
    rows += [(70, None), (71, ""), (72, " \t\n"), (73, "one"), (74, "Ä é ÉCOLE straße, x."), (75, rows[5][1]), (76, rows[5][1])]
    rows += [(77, " ".join(words(rng, 20000))), (78, "ab cd " * 300), (79, "x " * 100), (80, "\r\n tok * # <b> \x0b end")]
    rows += [rows[10], rows[10], (None, "no id " + passage), (81, rows[60][1].upper())]
    sources = ["s2", "s1", None, "S3", "s1", "z"]
    return [(d, t, "en", sources[i % 6] if d is not None else None, len(t or ""), "k", i) for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
