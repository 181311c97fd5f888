import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.sources import readers as R
from seqloom.sources import sinks as K
from seqloom.streaming.rolling import bursts, rolling_windows

SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("n", T.IntegerType())])


def test_typed_csv_drops_the_mark(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿id,n\na,1\nb,2\n", encoding="utf-8")
    rows = R.typed_csv(spark, str(p), SCHEMA).orderBy("id").collect()
    assert [(r.id, r.n) for r in rows] == [("a", 1), ("b", 2)]
    p.write_text("id,m\na,1\n")
    with pytest.raises(ValueError, match="expected"):
        R.typed_csv(spark, str(p), SCHEMA)
    p.write_text("id,n\na,x\n")
    with pytest.raises(Exception, match="x"):
        R.typed_csv(spark, str(p), SCHEMA).collect()
    assert R.typed_csv(spark, str(p), SCHEMA, strict=False).first().n is None


def test_split_rows(spark):
    d = spark.createDataFrame([("a", ""), ("b", "train")], "id string, split string")
    assert {r.split for r in R.split_rows(d, "train").collect()} == {"train"}
    with pytest.raises(ValueError):
        R.split_rows(d, "val")
    assert R.split_rows(d.drop("split"), "val").first().split == "val"


def test_roles_profile_inventory(spark, tmp_path):
    r = R.role_candidates(["Name", "video-id", "class", "file_path", "grid", "width", "status", "source video", "my_file_name"])
    assert r == {"video_id": ["video-id", "source video", "my_file_name"], "label": ["class", "status"], "source_path": ["file_path", "source video"]}
    d = spark.createDataFrame([("a", " "), ("a", " "), (None, "x")], "k string, v string")
    got = {x.column: (x.n_rows, x.n_blank, x.n_distinct) for x in R.profile(d).collect()}
    assert got == {"k": (3, 1, 1), "v": (3, 2, 2)}
    assert tuple(R.duplicate_rows(d).first()) == (3, 1)
    (tmp_path / "s").mkdir()
    (tmp_path / "s/a.MP4").write_bytes(b"abc")
    (tmp_path / "s/b.txt").write_bytes(b"")
    f = R.file_inventory(spark, str(tmp_path), [".mp4"]).collect()
    assert [(x.name, x.stem, x.length) for x in f] == [("a.MP4", "a", 3)]
    h = {x.length: x.sha256 for x in R.file_digests(spark, str(tmp_path)).collect()}
    assert h[3] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_batches_hold_every_row_once(spark):
    d = spark.range(100).withColumnRenamed("id", "i")
    for seed in (None, 5):
        rows = R.batches(d, "i", 16, seed).collect()
        assert sorted(r.i for r in rows) == list(range(100)) and sorted((r.batch, r.position) for r in rows) == [(i // 16, i % 16) for i in range(100)]
    again = {r.i: r.batch for r in R.batches(d.repartition(5), "i", 16, 5).collect()}
    assert again == {r.i: r.batch for r in rows}


def test_publish_and_resume(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    path = str(tmp_path / "bundle")
    policy = {"max": 8}
    assert K.bundle_status(spark, path, policy, "s") == "PROCESS"
    marker = K.publish(d, path, policy, "s")
    assert marker["rows"] == 2 and K.bundle_status(spark, path, policy, "s") == "SKIP"
    assert K.bundle_status(spark, path, {"max": 9}, "s") == "CONFLICT_PROVENANCE"
    with pytest.raises(K.Exists):
        K.publish(d, path, policy, "s")
    d.limit(1).write.mode("append").parquet(path)
    assert K.bundle_status(spark, path, policy, "s") == "CONFLICT_INVALID_BUNDLE"
    d.write.parquet(str(tmp_path / "bare"))
    assert K.bundle_status(spark, str(tmp_path / "bare"), policy, "s") == "CONFLICT_INCOMPLETE"


def test_failed_validation_leaves_nothing(spark, tmp_path):
    def refuse(_):
        raise ValueError("no")

    d = spark.range(3)
    with pytest.raises(ValueError):
        K.publish(d, str(tmp_path / "x"), {}, "s", refuse)
    assert list(tmp_path.iterdir()) == []


def test_csv_columns_and_manifest(spark, tmp_path):
    d = spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError):
        K.write_csv(d, str(tmp_path / "c"), ["k"])
    K.write_csv(d, str(tmp_path / "c"), ["v", "k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["v", "k"]
    K.write_csv(d.limit(0), str(tmp_path / "e"), ["v", "k"])
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == ["v", "k"]
    K.write_report(d.limit(0), str(tmp_path / "r.csv"), ["v", "k"])
    assert (tmp_path / "r.csv").read_bytes() == "\ufeffv,k\n".encode()
    with pytest.raises(K.Exists):
        K.write_report(d, str(tmp_path / "r.csv"), ["v"])
    for name in "ab":
        K.publish(d, str(tmp_path / "m" / name), {}, "s")
    K.publish(d.withColumn("v", F.lit("z")), str(tmp_path / "m/c"), {}, "s", partition_by=["v"])
    # What is being staged and what has no marker isn't published.
    K.write_once(d, str(tmp_path / f"m/d{K.STAGING}1"))
    K.write_once(d, str(tmp_path / "m/bare"))
    whole, twice = K.global_manifest(spark, str(tmp_path / "m"), "k")
    assert sorted(r.v for r in whole.collect()) == ["a", "a", "z"] and twice.first().n == 3
    assert sorted(r.id for r in K.bundle_ids(spark, str(tmp_path / "m")).collect()) == ["a", "b", "c"]
    assert K.unchanged(d, d) and not K.unchanged(d, whole)
    left, right = (spark.createDataFrame([x], "a string, b string") for x in ((None, "a"), ("a", None)))
    assert not K.unchanged(left, right) and not K.unchanged(d, d.withColumn("k", F.col("k").cast("long")))


def test_sets_of_tables_and_races(spark, tmp_path):
    d = spark.range(3)
    path = str(tmp_path / "set")
    marker = K.publish_set({"one": d, "two": d.limit(1)}, path, {}, "s", file_hashes=True)
    assert marker["rows"] == 4 and set(marker["tables"]) == {"one", "two"} and all(len(h) == 64 for h in marker["files"].values())
    assert K.bundle_status(spark, path, {}, "s") == "SKIP"
    d.write.parquet(path + "/three")
    assert K.bundle_status(spark, path, {}, "s") == "CONFLICT_INVALID_BUNDLE"
    # Another publisher holds the lock, or was faster: nothing is moved into its bundle.
    (tmp_path / "busy.lock").write_text("")
    with pytest.raises(K.Exists):
        K.publish(d, str(tmp_path / "busy"), {}, "s")

    def meanwhile(_):
        (tmp_path / "late").mkdir()

    with pytest.raises(K.Exists):
        K.publish(d, str(tmp_path / "late"), {}, "s", meanwhile)
    assert list((tmp_path / "late").iterdir()) == [] and not [p for p in tmp_path.iterdir() if K.STAGING in p.name]
    s = spark.createDataFrame([("a", "SKIP"), ("b", "SKIP")], "id string, status string")
    assert K.finished(s, {"n": 2}) == {"n": 2, "resumed": True} and K.finished(s.withColumn("status", F.lit("PROCESS")), {}) is None


def test_strict_csv_and_metadata(spark, tmp_path):
    write = lambda name, text: (tmp_path / name).write_text(text, encoding="utf-8")
    write("a.csv", "\ufeff id , n\n a ,1\nb\n")
    write("b.csv", "id,id\n1,2\n")
    write("c.csv", "id,\n1,2\n")
    write("d.csv", "id,n\n1,2,3\n")
    write("e.csv", "")
    read, errors = R.metadata_tables(spark, str(tmp_path), ["a.csv", "b.csv", "c.csv", "d.csv", "e.csv", "none.csv"])
    assert list(read) == ["a.csv"] and [tuple(r) for r in read["a.csv"].collect()] == [("a", "1"), ("b", "")]
    assert [e.split(":")[0] for e in errors] == ["b.csv", "c.csv", "d.csv", "e.csv"]
    files = R.file_inventory(spark, str(tmp_path), [".csv"])
    keys = {r.key for r in R.lookup_keys(files, str(tmp_path.parent), str(tmp_path)).where("path LIKE '%a.csv'").collect()}
    assert keys == {f"project:{tmp_path.name.lower()}/a.csv", "raw:a.csv", "name:a.csv", "stem:a"}
    prints = R.source_fingerprints(spark, str(tmp_path))
    assert prints.count() == 4 and prints.select("fingerprint").distinct().count() == 4
    d = spark.createDataFrame([("b", 1), ("a", 2), ("a", 1)], "v string, slot int")
    assert [(r.v, r.slot) for r in R.ordered_mapping(d, ["v", "slot"]).orderBy("position").collect()] == [("a", 1), ("a", 2), ("b", 1)]
    with pytest.raises(ValueError):
        R.ordered_mapping(d, ["v"])


def test_streaming_windows_equal_the_batch_form(spark, tmp_path):
    rows = [("u", f"2024-01-01 00:00:{s:02d}", float(s)) for s in (0, 1, 5, 12, 30)]
    d = spark.createDataFrame(rows, "user string, t string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    d.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    for name, op in (("w", lambda x: rolling_windows(x, "ts", ["user"], "value", "10 seconds", "5 seconds")), ("b", lambda x: bursts(x, "ts", ["user"], "8 seconds"))):
        mode = "complete" if name == "w" else "append"
        q = op(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {tuple(r) for r in spark.table(f"out_{name}").collect()}
        want = {tuple(r) for r in op(d).collect()}
        assert got == want if name == "w" else got <= want
    assert len(want) == 2


def test_reports_are_bounded_and_old_locks_go(spark, tmp_path):
    d = spark.range(5)
    with pytest.raises(ValueError, match="4 rows at most"):
        K.write_report(d, f"file://{tmp_path}/r.csv", ["id"], most=4)
    K.write_report(d, f"file://{tmp_path}/r.csv", ["id"], most=5)
    lock = tmp_path / "b.lock"
    lock.write_text("")
    with pytest.raises(K.Exists, match="being published"):
        K.publish(d, f"file://{tmp_path}/b", {}, "s")
    os.utime(lock, (1, 1))
    assert K.publish(d, f"file://{tmp_path}/b", {}, "s")["rows"] == 5 and not lock.exists()


def test_tables_of_many_files_in_an_inventory(spark, tmp_path):
    spark.range(10).repartition(3).write.parquet(str(tmp_path / "a.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(tmp_path / "sub" / "b.Parquet"))
    (tmp_path / "c.parquet").write_bytes(b"123")
    (tmp_path / "d.txt").write_bytes(b"1")
    size = lambda folder: sum(p.stat().st_size for p in folder.glob("part-*"))
    got = {(r.name, r.stem, r.extension, r.length) for r in R.file_inventory(spark, str(tmp_path), [".parquet"], whole_tables=True).collect()}
    assert got == {("a.parquet", "a", ".parquet", size(tmp_path / "a.parquet")), ("b.Parquet", "b", ".parquet", size(tmp_path / "sub" / "b.Parquet")), ("c.parquet", "c", ".parquet", 3)}
