"""The stages of the pipeline, each against a brute-force version, on its own input."""

import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as C
from tests.llm.test_jaccard_join import brute as brute_components
from tests.llm.test_repetition import brute_longest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    make = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    passage = make(70)
    out = []
    for i in range(80):
        text = make(rng.randint(60, 300))
        if i % 8 == 0:
            text = f"{text} {passage} {make(5)}"
        out.append((i, text))
    out += [(80 + i, out[i][1]) for i in range(5)]
    for i in range(90, 96):
        w = out[10][1].split()
        w[i % len(w)] = f"e{i}"
        out.append((i, " ".join(w)))
    out += [(100, "short text"), (101, None), (102, ""), (103, "spam spam spam " * 60), (104, out[20][1]), (104, out[20][1])]
    block = make(40)
    out.append((105, f"{make(40)} {block} {make(10)} {block}"))
    return [(d, t, "en", f"s{d % 3}", len(t or "")) for d, t in out]


def kept_by_rules(text):
    w = WORD.findall(text or "")
    at = {}
    for i in range(len(w) - 2):
        at.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 3)}
    if len(w) < 50 or 100 * len(again) > 50 * len(w):
        return False
    longest = brute_longest(w)
    cover = {j for i, n in enumerate(longest) if n >= 8 for j in range(i, i + n)}
    return len(cover) <= 0.3 * len(w) and (max(longest) < 8 or max(longest) <= 0.2 * len(w))


def test_every_stage(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, COLUMNS)
    stage = dict(C.STAGES)
    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "repeated_passages", "mixing", "packing"]

    def run(name, d):
        path = str(tmp_path / name)
        stage[name](spark, d, "").write.parquet(path)
        return spark.read.parquet(path)

    good = run("quality", docs)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == sorted(r[0] for r in rows if kept_by_rules(r[1]))

    single = run("near_duplicates", good)
    assert single.columns == docs.columns
    groups = brute_components([(r.doc_id, r.text) for r in good.collect()], 5, 80)
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in groups})

    stripped = run("repeated_passages", single)
    assert stripped.columns == docs.columns and stripped.count() == single.count()
    texts = {r.doc_id: WORD.findall(r.text) for r in single.collect()}
    counts = Counter(tuple(w[i : i + 35]) for w in texts.values() for i in range(len(w) - 34))
    for r in stripped.collect():
        w = texts[r.doc_id]
        gone = {j for i in range(len(w) - 34) if counts[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        assert WORD.findall(r.text) == [x for j, x in enumerate(w) if j not in gone] and r.n_chars == len(r.text)

    mixed = run("mixing", stripped)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 3
    from seqloom.llm.mixing import targets

    size, taken = Counter(), Counter()
    for r in stripped.collect():
        size[r.source] += len(WORD.findall(r.text))
        taken[r.source] += len(WORD.findall(r.text)) * times[r.doc_id]
    for s, t in targets(list(size.items())).items():
        assert abs(taken[s] - t) <= 0.01 * t

    packed = run("packing", mixed).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == times
    fill = Counter()
    for r in packed:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 4096
    from seqloom.llm.packing import lower_bound

    assert len(fill) == lower_bound(np.array([r.length for r in packed]))


def test_stages_keep_columns_of_any_name_and_type(spark):
    """Names that operators use, names that differ in case only, nested fields with odd names."""
    rng = random.Random(9)
    make = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    names = ["row_key", "ROW_KEY", "row_sub", "hits", "asks", "copies", "__row", "__size", "size", "h", "bucket", "times", "time", "node", "name", "sig", "root", "n_words", "kept", "c0", "C1", "id", "part", "a.b", "a`b"]
    passage, long = make(60), make(120_000)
    texts = [make(80) + " " + passage for _ in range(4)] + [make(90) for _ in range(6)] + [long]
    rows = [(*[f"{n}{i}" for n in names], i, "s", t, {"x y": i, "z-1": [i, None]}, {"k": i}) for i, t in enumerate(texts)]
    nested = "struct<`x y`:bigint,`z-1`:array<bigint>>, map<string,bigint>".split(", ")
    quoted = ["`" + n.replace("`", "``") + "`" for n in names]
    d = spark.createDataFrame(rows, ", ".join(f"{q} string" for q in quoted) + f", doc_id long, source string, text string, nest {nested[0]}, pairs {nested[1]}")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns and [f.dataType for f in out.schema] == [f.dataType for f in d.schema], name
        for r in out.collect():
            i = r.doc_id
            assert tuple(r)[: len(names)] == rows[i][: len(names)] and r.nest["x y"] == i and r.nest["z-1"] == [i, None] and r.pairs == {"k": i}, name
    assert C.STAGES[-1][1](spark, d, "").where("piece = 0").count() == len(rows)


def test_run_on_tables(spark, sf):
    assert C.run(spark, sf).count() > 0 and C.ORACLE_SQL is None


def test_stages_take_an_empty_table(spark):
    d = spark.createDataFrame([], COLUMNS)
    for name, f in C.STAGES:
        assert f(spark, d, "").count() == 0, name
