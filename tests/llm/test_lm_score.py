import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from seqloom.llm import kernel as K
from seqloom.llm import lm_score as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(rows):
    tokens = [(r[0], WORD.findall((r[1] or "").translate(LOWER)) + [None]) for r in rows]
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    c = Counter(x for d, t in tokens if not held(d) for x in t)
    n, v = sum(c.values()), len(c)
    return [(d, held(d), len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for d, t in tokens]


def test_base_scores_match_brute_force(docs, corpus, empty):
    got = sorted((tuple(r)[:6] for r in L.score_documents(docs).collect()), key=lambda r: (str(r[0]), r[5]))
    want = sorted(base(corpus), key=lambda r: (str(r[0]), r[5]))
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) <= 1e-8 * abs(b[5])
    assert L.score_documents(empty).count() == 0


def test_counts_without_kept_words(docs, corpus, monkeypatch):
    """Words beyond the kept ones are joined with their counts; scores stay the same."""
    monkeypatch.setattr(L, "KEPT_WORDS", 3)
    monkeypatch.setattr(L, "LEAST_WORDS", 2)
    got = sorted((r.base_score for r in L.score_documents(docs, rounds=1).collect()))
    assert np.allclose(got, sorted(r[5] for r in base(corpus)), rtol=1e-8)


def hashed(words):
    return K.words(K.texts(pa.array(words, pa.string()))).hashes(lower=True)


def batch(texts, m):
    return L.coded(K.words(K.texts(pa.array(texts, pa.string()))), m)


def small_model(train):
    """The unigram model of some texts with eight words in the vocabulary besides the end."""
    counts = Counter(w for t in train for w in t.split())
    names = [w for w, _ in counts.most_common(8)]
    rest = [w for w in counts if w not in names]
    tails = Counter()
    for w, t in zip(rest, L.tail_class(hashed(rest)).tolist(), strict=True):
        tails[t] += counts[w]
    distinct = Counter(L.tail_class(hashed(rest)).tolist())
    return L.unigram_model(hashed(names), np.array([counts[w] for w in names]), len(train), [(t, n, distinct[t]) for t, n in tails.items()]), counts


def brute_score(text, m, counts):
    """log10 of a text's probability, token by token in plain Python."""
    ids = dict(zip(m.vocabulary.tolist(), m.ids.tolist(), strict=True))
    mix = lambda x: int(K.mix(np.array([x & K.MASK], np.uint64))[0])
    words = WORD.findall((text or "").translate(LOWER))
    h = [int(x) for x in hashed(words)] + [int(L.END_HASH)] if words else [int(L.END_HASH)]
    total = 0.0
    for i, x in enumerate(h):
        p1, p2 = (h[i - 1] if i else int(L.START_HASH)), (h[i - 2] if i > 1 else int(L.START_HASH))
        a, b = mix(p1 ^ int(L._KEYS[0])), mix(p2 ^ int(L._KEYS[1]))
        target = L.END if i == len(h) - 1 else ids.get(x)
        top = m.width + (x >> 7) % L.TAILS if target is None else target // m.width ** (L.LEVELS - 1)
        z = [float(m.bias[0][c]) + sum(float(m.weights[0][f % len(m.weights[0])][c]) for f in (a, b)) for c in range(m.width + L.TAILS)]
        total += z[top] - math.log(sum(map(math.exp, z)))
        if target is None:
            total += math.log((counts[words[i]] + L.ADD) / m.tail_mass[top - m.width])
        for level in range(1, L.LEVELS) if target is not None else ():
            size = m.width ** (L.LEVELS - 1 - level)
            node = target // (size * m.width)
            rows = [mix(f + (node + level * m.width**L.LEVELS) * int(L._KEYS[2])) % len(m.weights[level]) for f in (a, b)]
            z = [float(m.bias[level][node][j]) + sum(float(m.weights[level][r][j]) for r in rows) for j in range(m.width)]
            total += z[target // size % m.width] - math.log(sum(map(math.exp, z)))
    return total / math.log(10)


def test_scores_match_brute_force(docs, corpus, monkeypatch):
    """The whole query's score on the small corpus, from the model it trained."""
    monkeypatch.setattr(L, "KEPT_WORDS", 40)
    monkeypatch.setattr(L, "LEAST_WORDS", 30)
    scored, m, _ = L._scored(docs, 2, 3000)
    assert 0 < len(m.vocabulary) <= 30 and all(w.any() for w in m.weights)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0
    counts = Counter(x for r in corpus if not held(r[0]) for x in WORD.findall((r[1] or "").translate(LOWER)))
    short = [r for r in corpus if len(r[1] or "") < 3000]
    got = {(r.doc_id, r.n_tokens): r.score for r in scored.collect()}
    for r in short[::4] + short[-8:]:
        want = brute_score(r[1], m, counts)
        assert abs(got[r[0], len(WORD.findall(r[1] or "")) + 1] - want) <= 1e-4 * abs(want)


def test_reruns_agree_however_files_are_split(docs):
    a, b = (sorted((r.doc_id or -1, r.score) for r in L.score_documents(d, part_tokens=4000).collect()) for d in (docs, docs.repartition(7)))
    assert np.allclose([x[1] for x in a], [x[1] for x in b], rtol=1e-9)


def test_model_is_a_distribution_and_learns():
    rng = random.Random(2)
    text = lambda n: " ".join(("den", "hut", "den", "rot")[i % 4] if rng.random() < 0.9 else f"r{rng.randrange(300)}" for i in range(n))
    train = [text(400) for _ in range(60)]
    m, counts = small_model(train)
    t = L.Trainer(m, 0.5)
    test = [text(400) for _ in range(5)]
    before = L.log_probs(batch(test, m), m).mean()
    for _ in range(3):
        t.learn(batch(train, m))
    assert L.log_probs(batch(test, m), t.m).mean() > before + 0.3
    # Over all words and one unseen one of each tail class, probabilities add up to one.
    for model in (m, t.m):
        seen = {w: 10 ** (brute_score(f"den hut {w}", model, counts) - brute_score("den hut", model, counts)) for w in ("den", "hut")}
        x = batch(["den hut q"], model)
        z = L._logits(0, next(L.choices(x, 2, 3, model)), model)[0].astype(float)
        assert np.isclose((np.exp(z) / np.exp(z).sum()).sum(), 1) and all(v > 0 for v in seen.values())
    mass = np.full(L.TAILS, L.ADD)
    for w, n in counts.items():
        if int(hashed([w])[0]) not in m.vocabulary.tolist():
            mass[int(L.tail_class(hashed([w]))[0])] += n + L.ADD
    assert np.allclose(mass, m.tail_mass)


def test_sums_of_rows():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        r = np.sort(rng.integers(0, max(1, n // 3) + 1, n))
        g = rng.normal(size=(n, 4))
        at, s, count = L.add_up(g.copy(), r)
        assert at.tolist() == sorted(set(r.tolist())) and count.tolist() == [int((r == a).sum()) for a in at]
        assert np.allclose(s, [g[r == a].sum(axis=0) for a in at])


def test_gradient_step_is_adagrad_on_the_sums_of_each_row(monkeypatch):
    """Steps on rows met once, a few times and often, against one row at a time; the tables are
    not touched elsewhere."""
    monkeypatch.setattr(L, "LEAST_ROWS", 64)
    monkeypatch.setattr(L, "STEP", 300)
    rng = np.random.default_rng(5)
    words = [f"w{int(i)}" for i in rng.zipf(1.3, 1500) % 200]
    m, _ = small_model([" ".join(words)])
    assert len(m.weights[0]) == 64
    x, t = batch([" ".join(words)], m), L.Trainer(m, 0.5)
    want = [w.astype(float) for w in m.weights]
    squares, met, groups = [np.zeros(len(w)) for w in want], [np.zeros(len(w)) for w in want], set()
    for lo in range(0, len(x.h), L.STEP):
        for level, c in enumerate(L.choices(x, lo, min(lo + L.STEP, len(x.h)), m)):
            sums, times = {}, Counter()
            for i in range(len(c.at)):
                bias = m.bias[level] if level == 0 else m.bias[level][c.node[i]]
                z = bias + sum(want[level][r[i]] for r in c.rows)
                p = np.exp(z) / np.exp(z).sum()
                p[c.picked[i]] -= 1
                for r in c.rows:
                    sums[int(r[i])] = sums.get(int(r[i]), 0) + p
                    times[int(r[i])] += 1
            for r, g in sums.items():
                squares[level][r] += (g**2).sum()
                met[level][r] += times[r]
                want[level][r] = want[level][r] - 0.5 * g / math.sqrt(squares[level][r] / L.SPREAD + 1)
            groups.update(times.values())
    assert {1, 2, 3} < groups and max(groups) > 50
    t.learn(x)
    for level in range(L.LEVELS):
        assert np.allclose(t.m.weights[level], want[level], atol=1e-4) and (t.met[level] == met[level]).all()
        assert not t.m.weights[level][met[level] == 0].any() and not m.weights[level].any()


def test_scoring_has_no_exponentials_of_its_own(monkeypatch):
    """They are taken once a model, whatever the number of tokens; extreme weights stay finite."""
    text = " ".join(f"w{i % 23}" for i in range(3000))
    m, _ = small_model([text])
    rng = np.random.default_rng(6)
    m = m._replace(weights=tuple(rng.choice(np.float32([-L.LIMIT, -1, 0, 1, L.LIMIT]), w.shape) for w in m.weights))
    x, want = batch([text], m), np.zeros(3001)
    for level, c in enumerate(L.choices(x, 0, len(x.h), m)):
        z = L._logits(level, c, m).astype(float)
        want[c.at] += z[np.arange(len(z)), c.picked] - np.log(np.exp(z).sum(1))
    e, seen, exp = L.factors(m), [], np.exp
    monkeypatch.setattr(np, "exp", lambda z, *a, **k: seen.append(1) or exp(z, *a, **k))
    got = L.log_shares(x, e)
    assert not seen and np.isfinite(got).all() and np.allclose(got, want, rtol=1e-5, atol=1e-5)


def test_whole_model_beats_unigrams_on_held_out_text(spark):
    rng = random.Random(4)
    rows = []
    for i in range(400):
        lang = rng.choice("ab")
        rows.append((i, " ".join(f"{lang}{min(int(rng.expovariate(0.1)), 60)}" for _ in range(120))))
    out = L.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg({"score": "sum", "base_score": "sum"}).first()
    assert out["sum(score)"] > out["sum(base_score)"] * 0.95


def test_context_codes():
    a = hashed(["a"])
    m = L.unigram_model(a, np.array([5]), 1, [])
    x = batch(["A a", "", "a"], m)
    assert x.target.tolist() == [1, 1, L.END, L.END, 1, L.END] and x.of.tolist() == [0, 0, 0, 1, 2, 2]
    one, two = K.mix(a ^ L._KEYS[0])[0], K.mix(a ^ L._KEYS[1])[0]
    none = [K.mix(np.array([L.START_HASH]) ^ L._KEYS[i])[0] for i in (0, 1)]
    assert x.a.tolist() == [none[0], one, one, none[0], none[0], one] and x.b.tolist() == [none[1], none[1], two, none[1], none[1], none[1]]


def test_sizes_follow_the_training_tokens():
    assert [L.words_for(n) for n in (0, 10**9, 10**13)] == [L.LEAST_WORDS, 10**9 // L.TOKENS_A_WORD, L.MOST_WORDS]
    assert [L.width_for(n) for n in (0, 63, 64, 32_767, 32_768, L.MOST_WORDS)] == [4, 4, 8, 32, 36, 128]
    assert L.rows_for(1, 32) == L.LEAST_ROWS and L.rows_for(L.TOKENS_A_ROW * 10_000, 32) == 1 << 14 and L.rows_for(10**12, 32) == L.MOST_ROWS
    for width in (4, 32, 52, 128):
        assert L.rows_for(10**12, width) * 4 * (L.LEVELS * width + L.TAILS) <= L.MODEL_BYTES


def test_tree_of_classes():
    """Masses of all levels are the counts of the words below, which are the paths' product."""
    h = hashed([f"w{i}" for i in range(100)])
    counts = np.arange(100, 0, -1)
    m = L.unigram_model(h, counts, 7, [(0, 5, 2)])
    total = 7 + counts.sum() + L.ADD * m.width**L.LEVELS + 5 + L.ADD * (2 + L.TAILS)
    x = batch([" ".join(f"w{i}" for i in range(100)), "unseen"], m)
    lp = L.log_probs(x, m)
    assert m.width == 8 and np.allclose(lp[:100], np.log((counts + L.ADD) / total), atol=1e-4)
    assert np.isclose(lp[100], math.log((7 + L.ADD) / total), atol=1e-4) and np.isclose(lp[101], math.log(m.tail_mass[L.tail_class(x.h[101:102])[0]] / total), atol=1e-4)


def test_words_that_share_one_count(spark, monkeypatch):
    """More words of one count than the vocabulary holds: all are tail words, none is dropped."""
    monkeypatch.setattr(L, "LEAST_WORDS", 4)
    rows = [(i, f"a{i} b{i} c{i}") for i in range(60)]
    scored, m, _ = L._scored(spark.createDataFrame(rows, "doc_id long, text string"), 1, None)
    got = sorted(tuple(r)[:6] for r in scored.collect())
    assert not len(m.vocabulary)
    for a, b in zip(got, sorted(base(rows)), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-8)


def test_base_columns_match_sql(spark, sf):
    import duckdb

    word = r"[^\x20\x09-\x0D]+"
    sql = f"""WITH d AS (SELECT doc_id, crc, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{word}') AS w FROM documents JOIN k USING (doc_id)),
    t AS (SELECT doc_id, crc % 10 = 0 AS held, unnest(list_append(w, '')) AS x FROM d), c AS (SELECT x, count(*) AS c FROM t WHERE NOT held GROUP BY x), s AS (SELECT sum(c) AS n, count(*) AS v FROM c)
    SELECT doc_id, any_value(held) AS held_out, count(*) AS n_tokens, count(c.c) AS n_known, any_value(n)::BIGINT AS train_tokens, sum(log10((coalesce(c.c, 0) + 0.1::DOUBLE) / (n + 0.1::DOUBLE * (v + 1)))) AS base_score FROM t LEFT JOIN c USING (x), s GROUP BY doc_id"""
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    import pandas as pd

    ids = [r[0] for r in db.execute("SELECT doc_id FROM documents").fetchall()]
    k = pd.DataFrame({"doc_id": ids, "crc": [zlib.crc32(str(i).encode()) for i in ids]})
    db.register("k", k)
    want = db.execute(sql).df().sort_values("doc_id").reset_index(drop=True)
    got = L.score_documents(spark.read.parquet(f"{sf}/documents.parquet")).toPandas().sort_values("doc_id").reset_index(drop=True)
    for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens"):
        assert (got[c] == want[c]).all(), c
    assert np.allclose(got["base_score"], want["base_score"], rtol=1e-9)


def test_nothing_to_train_on(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    rows = L.score_documents(spark.createDataFrame([(i, "a b c") for i in ids], "doc_id long, text string")).collect()
    assert all((r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (True, 4, 0, 0) and abs(r.base_score) < 1e-9 and r.score < 0 for r in rows)
