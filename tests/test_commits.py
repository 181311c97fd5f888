"""The log of bundles: concurrent and dying publishers, many bundles, versions; fingerprint trees."""

import threading

import pytest
from pyspark.sql import functions as F

from seqloom.functions.hashing import ordered_hash, stable_hash
from seqloom.operators import fingerprints as P
from seqloom.sources import commits as C
from seqloom.sources.sinks import Exists


def table(spark, low, high):
    return spark.range(low, high).select("id", (F.col("id") % 7).cast("string").alias("name"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/store"


def test_bundles_versions_and_states(spark, root):
    assert C.latest(spark, root) == -1 and C.committed(spark, root).isEmpty()
    with pytest.raises(FileNotFoundError):
        C.rows(spark, root)
    assert C.publish(table(spark, 0, 10), root, F.col("id") % 3, {"v": 1}, "s") == 0
    assert C.publish(table(spark, 10, 12), root, "007/é=%", {"v": 2}, "s") == 1
    assert ids(C.rows(spark, root)) == list(range(12)) and ids(C.rows(spark, root, 0)) == list(range(10))
    have = {r["bundle_id"]: (r["rows"], r["version"]) for r in C.committed(spark, root).collect()}
    assert have == {"0": (4, 0), "1": (3, 0), "2": (3, 0), "007/é=%": (2, 1)}
    with pytest.raises(Exists, match="'1', '2'"):
        C.publish(table(spark, 20, 30), root, F.col("id") % 2 + 1, {"v": 1}, "s")
    assert C.repeated(spark, root, "id").isEmpty() and C.latest(spark, root) == 1
    assert len(C.abandoned(spark, root)) == 1
    assert C.retract(spark, root, spark.createDataFrame([("0",), ("nothing",)], "bundle_id string")) == 2
    assert ids(C.rows(spark, root)) == [1, 2, 4, 5, 7, 8, 10, 11] and ids(C.rows(spark, root, 1)) == list(range(12))
    C.publish(table(spark, 100, 101), root, "0", {"v": 1}, "t")
    one, two = stable_hash({"v": 1}), stable_hash({"v": 2})
    wanted = spark.createDataFrame([("0", one, "t"), ("1", one, "s"), ("2", two, "s"), ("9", one, "s")], "bundle_id string, policy_hash string, source_hash string")
    for verify in (False, True):
        assert {r[0]: r[1] for r in C.states(spark, root, wanted, verify).collect()} == {"0": "SKIP", "1": "SKIP", "2": "CONFLICT_PROVENANCE", "9": "PROCESS"}


def test_changed_data_is_found(spark, root, tmp_path):
    C.publish(table(spark, 0, 10), root, F.col("id") % 2, {}, "s")
    path = next(p for p in (tmp_path / "store/data").glob("*/bundle_id=1"))
    table(spark, 0, 3).write.mode("append").parquet(str(path))
    wanted = spark.createDataFrame([(b, stable_hash({}), "s") for b in "01"], "bundle_id string, policy_hash string, source_hash string")
    assert {r[0]: r[1] for r in C.states(spark, root, wanted, True).collect()} == {"0": "SKIP", "1": "CONFLICT_INVALID_BUNDLE"}


def test_refusals_leave_nothing_visible(spark, root):
    def no(written):
        raise ValueError(f"{written.count()} rows")

    with pytest.raises(ValueError, match="10 rows"):
        C.publish(table(spark, 0, 10), root, "a", {}, validate=no)
    assert C.latest(spark, root) == -1 and len(C.abandoned(spark, root)) == 1
    C.publish(table(spark, 0, 10), root, "a", {})  # a publisher that died holds up no one
    assert ids(C.rows(spark, root)) == list(range(10))
    with pytest.raises(Exception, match="belongs to no bundle"):
        C.publish(table(spark, 0, 3), root, F.when(F.col("id") > 0, "b"), {})
    with pytest.raises(ValueError, match="schema"):
        C.publish(table(spark, 0, 3).withColumn("x", F.lit(1)), root, "c", {})
    with pytest.raises(ValueError, match="own"):
        C.publish(table(spark, 0, 3).withColumnRenamed("name", "bundle_id"), root, "c", {})
    assert ids(C.rows(spark, root)) == list(range(10))


def test_concurrent_publishers(spark, root):
    C.publish(table(spark, 0, 1), root, "first", {})
    outcome = []

    def work(i):
        try:
            outcome.append((i, C.publish(table(spark, 10 * i, 10 * i + 5), root, "same" if i >= 4 else f"b{i}", {})))
        except Exists:
            outcome.append((i, "refused"))

    threads = [threading.Thread(target=work, args=(i,)) for i in range(1, 7)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    won = [i for i, v in outcome if v != "refused"]
    assert len(outcome) == 6 and sorted(i for i in won if i < 4) == [1, 2, 3] and len([i for i in won if i >= 4]) == 1
    assert sorted(v for _, v in outcome if v != "refused") == [1, 2, 3, 4]
    assert ids(C.rows(spark, root)) == sorted([0, *(x for i in won for x in range(10 * i, 10 * i + 5))])


def test_snapshots_shorten_the_log(spark, root, monkeypatch):
    monkeypatch.setattr(C, "SNAPSHOT_EVERY", 3)
    monkeypatch.setattr(C, "FOLDER", 4)
    for i in range(8):
        C.publish(table(spark, i, i + 1).coalesce(1), root, f"b{i}", {"v": i})
    assert C._last_snapshot(spark, root, 7)[0] == 5 and C._last_snapshot(spark, root, 4)[0] == 2 and C._last_snapshot(spark, root, 1) == (-1, None)
    assert [ids(C.rows(spark, root, v)) for v in (0, 3, 5, 7)] == [[0], [0, 1, 2, 3], list(range(6)), list(range(8))]


def test_many_bundles_in_one_plan(spark, root):
    n = 400
    C.publish(table(spark, 0, n).repartition(4), root, F.col("id"), {})
    C.publish(table(spark, n, n + 50), root, F.lit("rest"), {})
    d = C.rows(spark, root)
    assert d.count() == n + 50 and C.committed(spark, root).count() == n + 1
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Union") <= 4 and plan.count("Relation [") <= 4


# ---- fingerprint trees


def numbers(spark, n, changed=()):
    return spark.range(n).select("id", F.when(F.col("id").isin(list(changed)) if changed else F.lit(False), "changed").otherwise(F.col("id").cast("string")).alias("v"))


def test_one_changed_row_is_found(spark):
    a, b = numbers(spark, 100_000), numbers(spark, 100_000, [77_777])
    one, two = (P.fingerprint_tree(x, "id", "id", "v", fan_out=16) for x in (a, b))
    assert sorted(r[0] for r in one.select("level").distinct().collect()) == [1, 2, 3, 4, 5]
    assert one.where("level = 5").first()["n"] == 100_000
    assert [r["node"] for r in P.differing_blocks(one, two, 16).collect()] == [77_777 // 16]
    assert [tuple(r) for r in P.differing_rows(a, b, "id", "id", "v", fan_out=16).collect()] == [(77_777, "CHANGED")]
    assert P.differing_blocks(one, P.fingerprint_tree(a.repartition(7), "id", "id", "v", fan_out=16), 16).isEmpty()


@pytest.mark.parametrize("sizes", [(0, 0), (0, 5), (5, 0), (3, 4), (100, 1000), (1000, 100), (255, 256), (256, 257)])
def test_trees_of_different_height(spark, sizes):
    a, b = (numbers(spark, n, [1] if n > 4 else []) for n in sizes)
    got = {tuple(r) for r in P.differing_rows(a, b, "id", "id", "v", fan_out=4).collect()}
    low, high = sorted(sizes)
    want = {(i, "ADDED" if sizes[1] > sizes[0] else "REMOVED") for i in range(low, high)}
    if low > 1 and (sizes[0] > 4) != (sizes[1] > 4):
        want.add((1, "CHANGED"))
    assert got == want


def test_ordered_hash_has_as_many_levels_as_it_needs(spark):
    h = lambda d, **k: tuple(ordered_hash(d, "id", "id", "v", **k).first())
    d = numbers(spark, 1000)
    assert h(d, fan_out=4) == h(d.repartition(5), fan_out=4) and h(d, fan_out=4)[1] == 1000
    assert h(d, fan_out=4)[0] != h(numbers(spark, 1000, [500]), fan_out=4)[0] and h(d.limit(0)) == h(numbers(spark, 0))
    plan = ordered_hash(d, "id", "id", "v", fan_out=4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 5  # 4 ** 5 numbers
