import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from seqloom.operators import integrity as I
from seqloom.operators import joins as J
from seqloom.operators import policy as P
from seqloom.operators import review as V
from seqloom.operators import sampling as M
from seqloom.operators import sets as U
from seqloom.operators import text as X
from seqloom.operators.assignment import assign_review_groups
from seqloom.operators.integrity import scattered_groups
from seqloom.operators.ordering import top_mass
from seqloom.sources.readers import scan_order


def test_checked_join(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, x string")
    b = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "k int, y double")
    assert J.checked_join(a, b, keys=["k"]).count() == 2
    with pytest.raises(J.Unmatched, match="no match"):
        J.checked_join(b, a, keys=["k"])
    with pytest.raises(J.Unmatched, match="more than once"):
        J.checked_join(a, b.unionByName(b), keys=["k"])


def test_prioritized_lookup(spark):
    left = spark.createDataFrame([(1, "p/a", "a"), (2, "zz", "b"), (3, "zz", "c"), (4, "p/d", "c")], "id int, path string, name string")
    right = spark.createDataFrame([(10, "p/a", "x"), (11, "q", "b"), (12, "r", "c"), (13, "s", "c"), (14, "p/d", "d")], "rid int, path string, name string")
    got = {r.left_id: (r.right_id, r.priority) for r in J.prioritized_lookup(left, "id", [(1, "path", right, "path", "rid"), (2, "name", right, "name", "rid")]).collect()}
    assert got == {1: (10, 1), 2: (11, 2), 4: (14, 1)}


def test_prioritized_lookup_of_a_common_key(spark):
    left, right = spark.range(20_000).withColumn("k", F.lit(1)), spark.range(20_000).select(F.col("id").alias("rid"), F.lit(1).alias("k"))
    right = right.unionByName(spark.createDataFrame([(7, 2), (7, 2)], "rid long, k int"))  # one row, there twice
    left = left.unionByName(spark.createDataFrame([(-1, 2), (-2, 2), (-2, 1)], "id long, k int"))
    found = J.prioritized_lookup(left, "id", [(1, "k", right, "k", "rid")])
    assert [tuple(r) for r in found.collect()] == [(-1, 7, 1)]
    joins = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")
    assert len(joins) == 2 and joins[1].count("Aggregate [k") == 1


def test_reconcile(spark):
    ids = lambda *v: spark.createDataFrame([(x,) for x in v], "k int")
    got = {r.k: r.status for r in J.reconcile(ids(1, 2), ids(2, 3), ["k"], universe=ids(1, 2, 3, 4)).collect()}
    assert got == {1: "LEFT_ONLY", 2: "BOTH", 3: "RIGHT_ONLY", 4: "NEITHER"}


def test_dictionary_encode_and_gather(spark):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "a", None, "c", "b"])], "i int, v string")
    coded, codes = J.dictionary_encode(d, "v")
    assert {r.i: r.code for r in coded.collect()} == {0: 1, 1: 0, 2: None, 3: 2, 4: 1}
    assert sorted((r.code, r.v) for r in codes.collect()) == [(0, "a"), (1, "b"), (2, "c")]
    s = spark.createDataFrame([(0, 5.0), (1, 6.0)], "code long, f double")
    rows = spark.createDataFrame([("v", 1, 0), ("v", 0, 1), ("v", 2, 1)], "id string, slot int, code long")
    assert J.gather(rows, s, "code", ["id"], "slot", "f", "fs").first().fs == [6.0, 5.0, 6.0]


def test_sets(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("c", 2), ("c", 3), ("b", 3)], "g string, k int")
    assert sorted((r.a, r.b, r.n) for r in U.pairwise_overlap(d, "g", "k").collect()) == [("a", "b", 1), ("a", "c", 1), ("b", "c", 2)]
    x, y = d.where("g = 'a'").select("k"), d.where("g = 'b'").select("k")
    assert sorted(r.k for r in U.symmetric_difference(x, y).collect()) == [1, 3]
    p = spark.createDataFrame([(0, "a"), (1, "b")], "at int, v string")
    assert J.same_sequence(p, p.repartition(2), "at").first().equal
    other = J.same_sequence(p, spark.createDataFrame([(0, "b"), (1, "a"), (2, "c")], "at int, v string"), "at").first()
    assert (other.positions, other.differing, other.equal) == (3, 3, False)
    s = J.same_rows(x, y).first()
    assert (s.only_left, s.only_right, s.equal) == (1, 1, False)
    whole, twice = U.union_checked("k", x, y)
    assert whole.count() == 4 and [r.k for r in twice.collect()] == [2]


def test_top_k_and_concentration(spark):
    d = spark.createDataFrame([(f"v{i:03d}", float(i)) for i in range(1, 31)], "id string, loss double")
    order = [F.desc("loss"), F.col("id")]
    assert [r.id for r in M.top_k(d, order, 3).orderBy("rank").collect()] == ["v030", "v029", "v028"]
    got = {r.top: (r.rows, r.share) for r in M.concentration_of_top(d, "loss", (("top_5", 5), ("top_10_percent", 0.1))).collect()}
    assert got["top_5"] == (5, pytest.approx(sum(range(26, 31)) / 465)) and got["top_10_percent"][0] == 3
    ties = spark.createDataFrame([("b", 1.0), ("a", 1.0)], "id string, loss double")
    assert [r.id for r in M.top_k(ties, order, 2).orderBy("rank").collect()] == ["a", "b"]


def test_round_robin_even_and_without_reuse(spark):
    d = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(5, 7)], "g string, i int")
    assert [(r.g, r.i) for r in M.round_robin(d, ["g"], [F.col("i")], 5).collect()] == [("a", 0), ("b", 5), ("a", 1), ("b", 6), ("a", 2)]
    even = spark.createDataFrame([("a", i) for i in range(10)] + [("b", i) for i in range(3)], "g string, i int")
    got = [(r.g, r.i) for r in M.evenly_spaced(even, ["g"], ["i"], 5).orderBy("g", "i").collect()]
    assert got == [("a", 0), ("a", 2), ("a", 5), ("a", 7), ("a", 9), ("b", 0), ("b", 1), ("b", 2)]
    assert M.evenly_spaced(even.where("g = 'b'"), ["g"], ["i"], 1).first().i == 1
    picked = M.without_reuse(d, "i", [("low", F.lit(True), [F.col("i")], 2), ("any", F.col("i") < 4, [F.col("i")], 2)]).collect()
    assert [(r.i, r.reason, r.place) for r in picked] == [(0, "low", 1), (1, "low", 2), (2, "any", 1), (3, "any", 2)]


SCORES = "sample_id string, split string, label string, eye_score double, mouth_score double, pose_score double, difficult_score double"


def reviewed(rows):
    """The rule, pair by pair, in memory."""
    names = ("eye", "mouth", "pose", "difficult")
    low, high = ([f(r[3 + i] for r in rows) for i in range(4)] for f in (min, max))
    scaled = {r[0]: [(r[3 + i] - low[i]) / (high[i] - low[i]) if high[i] > low[i] else 0.0 for i in range(4)] for r in rows}
    queues = {}
    for r in sorted(rows, key=lambda r: (scaled[r[0]][0] + scaled[r[0]][1] + scaled[r[0]][2] + scaled[r[0]][3], r[0])):
        queues.setdefault(r[1:3], []).append(r[0])
    out, turn = {}, 0
    while len(out) < 7:
        for k in sorted(queues):
            if turn < len(queues[k]) and len(out) < 7:
                out[queues[k][turn]] = "overview"
        turn += 1
    room = dict.fromkeys(names, 7)
    for _, item, g in sorted(((scaled[r[0]][i], r[0], g) for r in rows if r[0] not in out for i, g in enumerate(names)), reverse=True):
        if item not in out and room[g]:
            out[item] = g
            room[g] -= 1
    raw = {r[0]: dict(zip(names, r[3:], strict=True)) for r in rows}
    order = sorted(out, key=lambda s: (["overview", *names].index(out[s]), -raw[s].get(out[s], 0.0), s))
    return {s: (out[s], i) for i, s in enumerate(order, 1)}


@pytest.mark.parametrize("kind", ["random", "ties", "equal"])
def test_review_groups(spark, kind):
    rng = random.Random(7)
    value = {"random": rng.random, "ties": lambda: float(rng.randrange(3)), "equal": lambda: 1.0}[kind]
    rows = [(f"s{i:02d}", rng.choice(["train", "val"]), rng.choice("ab"), *(value() for _ in range(4))) for i in range(35)]
    got = assign_review_groups(spark.createDataFrame(rows, SCORES)).collect()
    assert {r["sample_id"]: (r["review_group"], r["review_order"]) for r in got} == reviewed(rows)
    assert Counter(r["review_group"] for r in got) == dict.fromkeys(("overview", "eye", "mouth", "pose", "difficult"), 7)
    first = {r["review_group"]: r["reason"] for r in got}
    assert first["overview"] == "LOW_MULTI_METRIC_CHANGE;BALANCED_NORMAL_REFERENCE" and first["eye"].startswith("EAR_CHANGE;score=") and first["pose"].endswith(";STEP2C_EXISTING_SELECTION")
    for wrong in (rows[:-1], [*rows, rows[0]], [*rows[:-1], rows[0]]):
        with pytest.raises(ValueError, match="35 different samples"):
            assign_review_groups(spark.createDataFrame(wrong, SCORES))


def test_picks_send_few_rows(spark):
    """Only k rows a group and task are shuffled, whatever the group's size."""
    d = spark.range(100_000).withColumns({"g": F.when(F.col("id") >= 0, "all"), "v": F.col("id") % 1000}).repartition(4)
    plan = M.top_k(d, [F.desc("v"), F.col("id")], 2, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    v = spark.range(1000).select(F.col("id").alias("video_id"), (F.col("id") % 17).alias("imputed_slots"), F.when(F.col("id") >= 0, "train").alias("split"), F.when(F.col("id") >= 0, "x").alias("label"))
    slots = v.select("video_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("slot")).withColumn("score", F.col("video_id") % 91 + F.col("slot"))
    for picked in (V.pilot(v, 8, True), V.review_slots(v, slots)):
        plan = picked._jdf.queryExecution().executedPlan().toString()
        assert plan.count("WindowGroupLimit") >= 2
    assert [r["video_id"] for r in V.pilot(v, 3, True).orderBy("place").collect()] == [16, 33, 50]
    got = {r["video_id"] for r in V.review_slots(v, slots).collect()}
    assert got == {90, 181, 0}


def test_top_mass(spark):
    rng = random.Random(1)
    rows = [(g, float(rng.randrange(1, 40))) for g in "ab" for _ in range(rng.randrange(50, 90))] + [("c", 2.0)] * 30 + [("a", None)]
    d = spark.createDataFrame(rows, "g string, x double")
    sizes = (("one", 1), ("ten", 10), ("many", 1000), ("tenth", 0.1), ("third", (1, 3)), ("all", 1.0))
    got = {(r["g"], r["name"]): (r["rows"], r["mass"], r["total"]) for r in top_mass(d, "x", sizes, ["g"]).collect()}
    for g in "abc":
        x = sorted((v for k, v in rows if k == g and v is not None), reverse=True)
        for name, k in sizes:
            n = math.ceil(len(x) * k) if isinstance(k, float) else -(-len(x) * k[0] // k[1]) if isinstance(k, tuple) else min(k, len(x))
            assert got[g, name] == (n, pytest.approx(sum(x[:n])), pytest.approx(sum(x)))
    plan = M.concentration_of_top(d, "x", (("half", 0.5),))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    assert [tuple(r) for r in M.concentration_of_top(d.limit(0), "x", (("half", 0.5),)).collect()] == [("half", 0, 0.0, 0.0)]


def test_scattered_groups(spark, tmp_path):
    files = {"a": [1, 1, 2, 2, 3], "b": [3, 4, 5, 4], "c": [6, 2, 7], "d": [7, 8], "e": [8, 9], "f": [8]}
    for name, keys in files.items():
        spark.createDataFrame([(k,) for k in keys], "k int").coalesce(1).write.parquet(f"{tmp_path}/t/{name}")
    d = scan_order(spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/t"))
    assert {tuple(r) for r in scattered_groups(d, "k").collect()} == {(4, "IN_FILE"), (2, "ACROSS_FILES"), (8, "ACROSS_FILES")}


def test_review_frames(spark):
    chosen = spark.createDataFrame([(1,), (2,), (3,)], "video_id long")
    runs = spark.createDataFrame([(1, 0, 3, 4), (1, 50, 53, 4), (2, 90, 99, 10), (2, 5, 5, 1), (9, 1, 2, 2)], "video_id long, start int, end int, length long")
    got = {r["video_id"]: (r["representative_start"], r["representative_end"], r["recommended_frames"]) for r in V.with_review_frames(chosen, runs).collect()}
    assert got == {1: (0, 3, "0;1;3;4"), 2: (90, 99, "89;90;94;99"), 3: (None, None, "0;50;99")}


CONTEXT = [(set(), "TTTTT"), ({5, 10}, "FTTTT"), ({5, 6}, "FFTTT"), ({5, 6, 7, 8, 9}, "FFFFT"), (set(range(32)), "FFFFF")]


@pytest.mark.parametrize("missing,want", CONTEXT)
def test_context_policies(spark, missing, want):
    run = max((sum(1 for _ in range(i, 32) if set(range(i, _ + 1)) <= missing) for i in missing), default=0)
    d = spark.createDataFrame([(32 - len(missing), len(missing), run)], "valid int, missing int, run int")
    rows = P.per_candidate(d, P.CONTEXT, lambda n, r: P.context_eligible(F.col("valid"), F.col("missing"), F.col("run"), n, r)).orderBy("candidate").collect()
    assert "".join("T" if r.eligible else "F" for r in rows) == want


@pytest.mark.parametrize("valid,run,want", [(94, 2, "TTFT"), (80, 21, "TFFF"), (0, 100, "FFFF"), (95, 5, "TTTT"), (99, 6, "TTFT")])
def test_behavior_policies(spark, valid, run, want):
    d = spark.createDataFrame([(valid, run)], "valid int, run int")
    rows = P.per_candidate(d, P.BEHAVIOR, lambda n, r: P.behavior_eligible(F.col("valid"), F.col("run"), n, r)).orderBy("candidate").collect()
    assert "".join("T" if r.eligible else "F" for r in rows) == want


def test_retention_of_an_empty_stratum(spark):
    d = spark.createDataFrame([("train", "pos", 1), ("train", "neg", 0), ("val", "pos", 0)], "split string, label string, ok int")
    c = d.withColumns({"candidate": F.lit("C"), "eligible": F.col("ok") == 1})
    got = {(r.group_type, r.split, r.label): r.rate for r in P.retention(c, ["split", "label"]).collect()}
    assert got["overall", None, None] == pytest.approx(1 / 3) and got["split", "val", None] == 0.0
    i = P.impact(c, "label").first()
    assert i.min_stratum_rate == 0.0 and i.max_shift == pytest.approx(100 / 3)


def test_integrity(spark):
    d = spark.createDataFrame([(1, 5, "train"), (2, None, "test")], "k int, x int, split string")
    rules = [("BIG", F.col("x") > 3), ("NO", F.col("x") < 0)]
    assert [(r.k, r.rule) for r in I.violations(d, ["k"], rules).collect()] == [(1, "BIG")]
    assert {r.rule: r.n for r in I.violation_counts(d, rules).collect()} == {"BIG": 1, "NO": 0}
    with pytest.raises(I.Sealed):
        I.seal(d, "split", ["test"])
    assert I.seal(d.where("k = 1"), "split", ["test"]).count() == 1
    assert I.dense_order(d, "k").first().dense is False
    assert I.table_fingerprint(d) == I.table_fingerprint(d.repartition(2)) != I.table_fingerprint(d.where("k = 1"))
    e = I.explained(d.select("k"), spark.createDataFrame([(1,)], "k int"), ["k"]).first()
    assert (e.unexplained, e.absent, e.exact) == (1, 0, False)


def test_review_text(spark):
    text = "intro\nREVIEW 01~03\nverdict:\nTRUE\nnote: two\nwords\n\nREVIEW 12\nverdict: FALSE\n"
    rows = X.review_blocks(spark.createDataFrame([(text,)], "t string"), F.col("t")).orderBy("review_id").collect()
    assert [r.review_id for r in rows] == ["01", "02", "03", "12"]
    assert rows[0].fields == {"verdict": "TRUE", "note": "two\nwords"} and rows[3].fields == {"verdict": "FALSE"}
