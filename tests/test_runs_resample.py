import pytest
from pyspark.sql import functions as F

from seqloom.operators import resample as S
from seqloom.operators import runs as W


def slots(spark, flags, key="v"):
    return spark.createDataFrame([(key, i, bool(f)) for i, f in enumerate(flags)], "id string, slot int, flag boolean")


@pytest.mark.parametrize("flags,want", [([1, 1, 0, 1, 0, 1], [(0, 1), (3, 3), (5, 5)]), ([0, 0], []), ([1, 1], [(0, 1)])])
def test_runs_of_members(spark, flags, want):
    r = W.runs(slots(spark, flags), ["id"], "slot", F.col("flag")).orderBy("run_id").collect()
    assert [(x.start, x.end) for x in r] == want and [x.run_id for x in r] == list(range(1, len(want) + 1))


def test_both_polarities_and_null_membership(spark):
    d = slots(spark, [1, 0, 0, 1])
    assert [(x.start, x.end) for x in W.runs(d, ["id"], "slot", ~F.col("flag")).collect()] == [(1, 2)]
    assert W.runs(d, ["id"], "slot", F.lit(None).cast("boolean")).count() == 0
    assert W.runs(d.limit(0), ["id"], "slot", F.col("flag")).count() == 0


def test_summary_of_100_slots(spark):
    missing = {0, 1, 5, 99}
    d = slots(spark, [i in missing for i in range(100)])
    r = W.run_summary(d, ["id"], "slot", F.col("flag")).first()
    assert (r.n_slots, r.n_member, r.n_runs, r.longest_run, r.first, r.last, r.touches_start, r.touches_end) == (100, 4, 3, 2, 0, 99, True, True)
    extra = F.count_if(F.pmod("slot", F.lit(3)) == 0).alias("selected")
    first = W.runs(d, ["id"], "slot", F.col("flag"), [extra]).orderBy("start").first()
    assert first.selected == 1
    r = W.run_summary(slots(spark, [0] * 5), ["id"], "slot", F.col("flag")).first()
    assert (r.n_member, r.n_runs, r.longest_run, r.first, r.touches_start) == (0, 0, 0, None, False)


def test_neighbours_within(spark):
    d = spark.createDataFrame([("v", i, float(i) if i in (0, 8) else None) for i in range(12)], "id string, slot int, x double")
    got = {r.slot: (r.value_before, r.value_after) for r in W.neighbours(d, ["id"], "slot", "x", 5).collect()}
    assert got[3] == (0.0, 8.0) and got[5] == (0.0, 8.0) and got[6] == (None, 8.0) and got[2] == (0.0, None) and got[8] == (None, None)


def test_monotone_and_transitions(spark):
    d = spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 2, 2, 1])] + [("b", 0, 5)], "id string, slot int, x int")
    assert {r.id: r.violations for r in W.monotone(d, ["id"], "slot", "x").collect()} == {"a": 1, "b": 0}
    assert {r.id: r.violations for r in W.monotone(d, ["id"], "slot", "x", strict=True).collect()} == {"a": 2, "b": 0}
    t = W.transitions(slots(spark, [0, 1, 1, 0]), ["id"], "slot", "flag", ("imputed", "original")).orderBy("slot").collect()
    assert [x.transition for x in t] == ["original_to_imputed", "imputed_to_imputed", "imputed_to_original"]


@pytest.mark.parametrize("valid,want", [
    ([1, 0, 0, 1], [0, 0, 3, 3]), ([0, 1, 1], [1, 1, 2]), ([1, 1, 0], [0, 1, 1]), ([0, 0], [None, None]), ([1, 0, 1], [0, 0, 2]),
])
def test_nearest_valid(spark, valid, want):
    r = S.nearest_valid(slots(spark, valid), ["id"], "slot", F.col("flag")).orderBy("slot").collect()
    assert [x.source_slot for x in r] == want


@pytest.mark.parametrize("missing,target,source", [({10}, 10, 9), ({0}, 0, 1), ({31}, 31, 30), ({0, 1, 2}, 0, 3), ({29, 30, 31}, 31, 28), ({10, 11, 12, 13}, 12, 14), ({9, 10, 11}, 10, 8), ({9, 10, 11}, 11, 12)])
def test_nearest_valid_of_32(spark, missing, target, source):
    r = S.nearest_valid(slots(spark, [i not in missing for i in range(32)]), ["id"], "slot", F.col("flag"))
    assert r.where(F.col("slot") == target).first().source_slot == source


def test_substitute_never_chains(spark):
    d = spark.createDataFrame([("v", i, i in (0, 5), float(i)) for i in range(6)], "id string, slot int, ok boolean, x double")
    r = S.substitute(d, ["id"], "slot", F.col("ok"), ["x"]).orderBy("slot").collect()
    assert [x.x for x in r] == [0.0, 0.0, 0.0, 5.0, 5.0, 5.0] and [x.imputed for x in r] == [False, True, True, True, True, False]


def test_grids_and_positions(spark):
    g = S.slot_grid(spark, 100, 10.0).orderBy("slot").collect()
    assert len(g) == 100 and g[0].target == 0.0 and g[-1].target == 9.9
    one = spark.range(1)
    at = lambda c: one.select(c.alias("x")).first().x
    assert at(S.source_index(F.lit(0.05), F.lit(10.0))) == 1 and at(S.source_index(F.lit(9.9), F.lit(30.0))) == 297
    p = at(S.even_positions(F.lit(100), 32))
    assert len(set(p)) == 32 and (p[0], p[-1]) == (0, 99)
    assert at(S.even_positions(F.lit(10), 5)) == [0, 2, 5, 7, 9] and at(S.even_positions(F.lit(9), 1)) == [4]
    assert at(S.truncated_positions(F.lit(10), 5)) == [0, 2, 4, 6, 9]
    t = F.array(F.lit(-1.0), F.lit(0.0), F.lit(2.0))
    assert at(S.within_duration(t, F.lit(2.0))) == [0.0] and at(S.within_duration(t, F.lit(None).cast("double"))) == [-1.0, 0.0, 2.0]


def test_hints(spark):
    d = slots(spark, [1, 0, 0, 0, 0, 0])
    got = {r.slot: r.hint for r in S.near_hint(d, ["id"], "slot", ~F.col("flag"), F.col("flag"), 2).collect()}
    assert got == {1: 0, 2: 0, 3: None, 4: None, 5: None}


def test_a_grid_is_not_shuffled(spark):
    from seqloom.operators.resample import on_grid

    keys = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, x int")
    seen = spark.createDataFrame([("a", 0, 5.0), ("a", 2, None), ("a", 2, 7.0), ("a", 3, 1.0), (None, 1, 1.0), ("c", 1, 1.0)], "k string, slot int, v double")
    g = on_grid(keys, seen, ["k"], 3)
    rows = sorted(map(str, map(tuple, g.collect())))
    want = [("a", 0, 1, 5.0), ("a", 1, 1, None), ("a", 2, 1, None), ("a", 2, 1, 7.0), *[("b", i, 2, None) for i in range(3)], *[(None, i, 3, None) for i in range(3)]]
    assert rows == sorted(map(str, want)) and g.columns == ["k", "slot", "x", "v"]
    plan = g._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda what: next(i for i, line in enumerate(plan) if what in line)
    assert at("Generate explode") < at("Join LeftOuter")
