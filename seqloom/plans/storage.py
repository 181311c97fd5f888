"""Sources and sinks: what is written comes back, with states, manifests and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from seqloom.functions import hashing as H
from seqloom.functions import scalars as S
from seqloom.operators.integrity import seal
from seqloom.operators.joins import same_sequence
from seqloom.operators.ordering import numbered
from seqloom.sources import commits as G
from seqloom.sources import readers as R
from seqloom.sources import sinks as K
from seqloom.sources.readers import table

from . import twins as T
from ._register import query

TABLES = "benchmark conversations customer documents embeddings events labels lineitem nation orders pages part region supplier".split()


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A report with a byte-order mark, read again with declared types."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = K.scratch(spark, "report") + ".csv"
    K.write_report(n, path, n.columns)
    return R.typed_csv(spark, path, Ty.StructType([Ty.StructField(f.name, f.dataType) for f in n.schema]))


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer)
SELECT 'c_custkey' AS "column", count(*) AS n_rows, 0::BIGINT AS n_blank, count(DISTINCT c_custkey) AS n_distinct FROM c UNION ALL SELECT 'segment', count(*), count(*) FILTER (segment = ''), count(DISTINCT segment) FROM c""")
def csv_profile(spark: SparkSession, d: str) -> DataFrame:
    """Part files of text, checked for shape and profiled in one pass."""
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"))
    path = K.scratch(spark, "customers")
    K.write_csv(c, path, c.columns)
    return R.profile(R.strict_csv(spark, path))


@query("SELECT 'nation.csv' AS name, 25::BIGINT AS n_rows, '' AS error UNION ALL SELECT 'twice.csv', NULL, 'a column name is there twice'")
def metadata_tables(spark: SparkSession, d: str) -> DataFrame:
    """Known files of a folder; one that can't be read is reported, one that isn't there is not."""
    root = K.scratch(spark, "metadata")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    K.write_report(n, f"{root}/nation.csv", n.columns)
    K.write_text(spark, f"{root}/twice.csv", "id,id\n1,2\n")
    read, errors = R.metadata_tables(spark, root, ["nation.csv", "twice.csv", "absent.csv"])
    rows = [(k, v.count(), "") for k, v in read.items()] + [(e.split(":")[0], None, e.rsplit(": ", 1)[1]) for e in errors]
    return spark.createDataFrame(rows, "name string, n_rows long, error string")


_NAMES = {"c_name": "Name", "c_custkey": "video-id", "c_mktsegment": "class", "c_acctbal": "file_path", "c_nationkey": "status"}


@query("""WITH r AS (SELECT * FROM (VALUES ('video_id', 1, 'video-id'), ('label', 1, 'class'), ('label', 2, 'status'), ('source_path', 1, 'file_path')) AS t(role, place, name)),
n AS (SELECT 'video-id' AS name, count(*) AS n_rows, count(DISTINCT c_custkey) AS n_distinct FROM customer UNION ALL SELECT 'class', count(*), count(DISTINCT c_mktsegment) FROM customer UNION ALL SELECT 'status', count(*), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'file_path', count(*), count(DISTINCT c_acctbal) FROM customer)
SELECT role, place, name, n_rows, n_distinct FROM r JOIN n USING (name)""")
def role_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns of a table that may fill each role, and what each of them holds."""
    c = table(spark, d, "customer").select(*[F.col(k).alias(v) for k, v in _NAMES.items()])
    found = [(role, i + 1, name) for role, names in R.role_candidates(c.columns).items() for i, name in enumerate(names)]
    held = c.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_distinct(f"`{n}`").alias(n) for n in {x[2] for x in found}])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(i).alias("place"), F.lit(n).alias("name"), F.col("n_rows"), F.col(f"`{n}`").alias("n_distinct")) for r, i, n in found])).alias("x")
    return held.select(each).select("x.*")


@query(f"WITH {T.USERS} SELECT video_id, 'train' AS split FROM users WHERE split = 'train'")
def split_filled(spark: SparkSession, d: str) -> DataFrame:
    """Blank splits filled in, others checked, forbidden ones sealed off."""
    u = T.users(spark, d).where("split = 'train'").withColumn("split", F.when(F.col("video_id") % 3 == 0, "").otherwise(F.col("split")))
    return seal(R.split_rows(u, "train"), "split", ["test"]).select("video_id", "split")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}.parquet', '{t}', '.parquet', 'name:{t}.parquet', 'stem:{t}')" for t in TABLES) + ") AS t(name, stem, extension, by_name, by_stem)")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Tables of a folder, files or folders of part files, without their content, and the keys
    they are found by."""
    f = R.file_inventory(spark, d, [".PARQUET"], whole_tables=True).where(F.col("name").isin([f"{t}.parquet" for t in TABLES]))
    k = R.lookup_keys(f, d, d).where("key LIKE 'name:%' OR key LIKE 'stem:%'").groupBy("path").agg(F.min("key").alias("by_name"), F.max("key").alias("by_stem"))
    return f.join(k, "path").select("name", "stem", "extension", "by_name", "by_stem")


@query("SELECT vec_id, vec_id AS position, label FROM embeddings")
def ordered_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Manifest order as a dense position, without a window over all rows."""
    e = table(spark, d, "embeddings").select("vec_id", "label").repartition(7, "label")
    return R.ordered_mapping(e, ["vec_id"]).select("vec_id", "position", "label")


@query("SELECT n_regionkey, n_nationkey, n_name, 'a' AS bundle FROM nation WHERE n_regionkey < 2 UNION ALL SELECT n_regionkey, n_nationkey, n_name, 'b' FROM nation WHERE n_regionkey >= 2")
def global_manifest(spark: SparkSession, d: str) -> DataFrame:
    """All published bundles as one table; what is staged or unmarked isn't among them."""
    n, root = table(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name"), K.scratch(spark, "bundles")
    K.publish(n.where("n_regionkey < 2").withColumn("bundle", F.lit("a")), f"{root}/a", {"v": 1}, "s", partition_by=["n_regionkey"])
    K.publish(n.where("n_regionkey >= 2").withColumn("bundle", F.lit("b")), f"{root}/b", {"v": 1}, "s", file_hashes=True)
    K.write_once(n, f"{root}/c{K.STAGING}0")
    K.write_once(n, f"{root}/bare")
    whole, twice = K.global_manifest(spark, root, "n_nationkey")
    if not twice.isEmpty():
        raise ValueError("a key stands in two bundles")
    return whole.select(F.col("n_regionkey").cast("int").alias("n_regionkey"), "n_nationkey", "n_name", "bundle")


@query("""WITH b AS (SELECT o_orderpriority || '/' || o_orderstatus AS bundle_id, o_orderkey, o_totalprice, o_orderdate FROM orders), k AS (SELECT * FROM b WHERE bundle_id <> '2-HIGH/F')
SELECT bundle_id, count(*) AS n, round(sum(o_totalprice), 2) AS price, CASE WHEN bundle_id LIKE '1%' THEN 0 ELSE 1 END::BIGINT AS version, CASE WHEN bundle_id LIKE '1%' THEN 'SKIP' ELSE 'CONFLICT_PROVENANCE' END AS status FROM k GROUP BY bundle_id
UNION ALL SELECT '2-HIGH/F', 0, NULL, NULL, 'PROCESS'""")
def committed_bundles(spark: SparkSession, d: str) -> DataFrame:
    """Orders published in many bundles by two commits, one bundle taken back, read as one table."""
    root = K.scratch(spark, "store")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", F.concat_ws("/", "o_orderpriority", "o_orderstatus").alias("of"))
    first = F.col("of").startswith("1")
    G.publish(o.where(first).withColumnRenamed("of", "name"), root, F.col("name"), {"v": 1}, "s")
    G.publish(o.where(~first).withColumnRenamed("of", "name"), root, F.col("name"), {"v": 2}, "s")
    G.retract(spark, root, spark.createDataFrame([("2-HIGH/F",)], "bundle_id string"))
    wanted = o.select(F.col("of").alias("bundle_id"), F.lit(H.stable_hash({"v": 1})).alias("policy_hash"), F.lit("s").alias("source_hash")).unionByName(spark.createDataFrame([("2-HIGH/F", H.stable_hash({"v": 1}), "s")], "bundle_id string, policy_hash string, source_hash string")).distinct()
    held = G.rows(spark, root).groupBy("bundle_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return G.states(spark, root, wanted).join(held, "bundle_id", "left").join(G.committed(spark, root).select("bundle_id", "version"), "bundle_id", "left").select("bundle_id", F.coalesce("n", F.lit(0)).alias("n"), "price", "version", "status")


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS number, o_totalprice AS p, o_orderstatus AS s FROM orders), b AS (SELECT number, CASE WHEN number % 997 = 5 THEN p + 1 ELSE p END AS p, s FROM a WHERE number < (SELECT count(*) FROM a) - 3)
SELECT coalesce(a.number, b.number) AS number, CASE WHEN b.number IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS difference FROM a LEFT JOIN b ON a.number = b.number WHERE b.number IS NULL OR a.p <> b.p OR a.s <> b.s""")
def fingerprint_differences(spark: SparkSession, d: str) -> DataFrame:
    """Rows that two versions of a table do not share, found down a tree of hashes."""
    from seqloom.operators.fingerprints import differing_rows

    a = numbered(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), [], ["o_orderkey"], "number")
    b = a.where("number < total - 3").withColumn("o_totalprice", F.when(F.col("number") % 997 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return differing_rows(a, b, "number", "o_totalprice", "o_orderstatus", fan_out=64)


@query("""WITH o AS (SELECT row_number() OVER () AS i, CASE WHEN l_orderkey % 97 = 0 THEN l_orderkey // 97 ELSE l_orderkey END AS k FROM lineitem)
SELECT k, 'IN_FILE' AS fault FROM o GROUP BY k HAVING max(i) - min(i) + 1 <> count(*)""")
def scattered_groups(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose lines do not stand together in their file, where some lines were filed wrongly."""
    from seqloom.operators.integrity import scattered_groups as scattered

    s = R.scan_order(table(spark, d, "lineitem")).select("scan_file", "scan_row", F.when(F.col("l_orderkey") % 97 == 0, F.expr("l_orderkey div 97")).otherwise(F.col("l_orderkey")).alias("k"))
    return scattered(s, "k")


@query("SELECT * FROM (VALUES ('before', 'PROCESS'), ('after', 'SKIP'), ('other policy', 'CONFLICT_PROVENANCE'), ('no marker', 'CONFLICT_INCOMPLETE'), ('one more table', 'CONFLICT_INVALID_BUNDLE'), ('again', 'refused'), ('once more', 'refused'), ('resumed', 'nothing to do'), ('left over', 'work')) AS t(step, status)")
def bundle_states(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of a bundle of two tables, step by step."""
    root = K.scratch(spark, "states")
    tables = {"nation": table(spark, d, "nation"), "region": table(spark, d, "region")}
    rows = [("before", K.bundle_status(spark, f"{root}/x", {"v": 1}, "s"))]
    K.publish_set(tables, f"{root}/x", {"v": 1}, "s", file_hashes=True)
    rows += [("after", K.bundle_status(spark, f"{root}/x", {"v": 1}, "s")), ("other policy", K.bundle_status(spark, f"{root}/x", {"v": 2}, "s"))]
    K.write_once(tables["nation"], f"{root}/bare")
    rows.append(("no marker", K.bundle_status(spark, f"{root}/bare", {"v": 1}, "s")))
    K.write_once(tables["region"], f"{root}/x/more")
    rows.append(("one more table", K.bundle_status(spark, f"{root}/x", {"v": 1}, "s")))

    def refused(write) -> str:
        try:
            write()
        except Exception as e:  # the writer's own error, or Spark's for a path that is there
            return "refused" if isinstance(e, K.Exists) or "PATH_ALREADY_EXISTS" in str(e) else str(e)
        return "written"

    rows += [("again", refused(lambda: K.publish_set(tables, f"{root}/x", {"v": 1}, "s"))), ("once more", refused(lambda: K.write_once(tables["nation"], f"{root}/bare")))]
    status = lambda *s: spark.createDataFrame([(x,) for x in s], "status string")
    rows += [("resumed", "nothing to do" if K.finished(status("SKIP", "SKIP"), {}) else "work"), ("left over", "nothing to do" if K.finished(status("SKIP", "PROCESS"), {}) else "work")]
    return spark.createDataFrame(rows, "step string, status string")


@query("SELECT * FROM (VALUES ('v1'), ('v2')) AS t(id)")
def bundle_ids(spark: SparkSession, d: str) -> DataFrame:
    root = K.scratch(spark, "ids")
    for name in ("v1", "v2"):
        K.publish(table(spark, d, "region"), f"{root}/{name}", {}, "s")
    K.write_once(table(spark, d, "region"), f"{root}/v3")
    return K.bundle_ids(spark, root)


@query("""SELECT s_nationkey, count(*) AS n, sha256(string_agg(s_name, chr(10) ORDER BY s_name) || chr(10)) AS content, sha256('{"files":1,"nation":' || s_nationkey || '}') AS policy, 1::BIGINT AS prints FROM supplier GROUP BY s_nationkey""")
def digests(spark: SparkSession, d: str) -> DataFrame:
    """Digests of written files' content, of the settings they stand for, and fingerprints of path,
    size and time."""
    root = K.scratch(spark, "files")
    s = table(spark, d, "supplier").select("s_nationkey", F.col("s_name").alias("value"))
    s.repartition("s_nationkey").sortWithinPartitions("s_nationkey", "value").write.partitionBy("s_nationkey").text(root)
    of = F.regexp_extract("path", "s_nationkey=([0-9]+)/", 1).cast("int").alias("s_nationkey")
    files = R.file_digests(spark, root).select(of, F.col("sha256").alias("content"))
    prints = R.source_fingerprints(spark, root).select(of, "fingerprint").groupBy("s_nationkey").agg(F.count_distinct("fingerprint").alias("prints"))
    n = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n"))
    policy = n.select("s_nationkey", "n", F.lit(1).alias("files"), F.col("s_nationkey").alias("nation")).select("s_nationkey", "n", H.row_hash("nation", "files").alias("policy"))
    return policy.join(files, "s_nationkey").join(prints, "s_nationkey").select("s_nationkey", "n", "content", "policy", "prints")


@query("""WITH r AS (SELECT n_nationkey AS o, sha256('{"v":' || n_nationkey || '}' || chr(10) || '{"v":"' || n_name || '"}') AS h FROM nation), b AS (SELECT o // 4096 AS b, sha256(string_agg(o || ':' || h, chr(10) ORDER BY o)) AS h, count(*) AS n FROM r GROUP BY 1)
SELECT sha256(string_agg(b || ':' || h, chr(10) ORDER BY b)) AS h, sum(n)::BIGINT AS n FROM b""")
def mapping_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """An order-sensitive hash of a relation of any size."""
    return H.ordered_hash(table(spark, d, "nation"), "n_nationkey", "n_nationkey", "n_name")


@query("SELECT * FROM (VALUES ('same', true), ('a row less', false), ('nulls elsewhere', false), ('another type', false)) AS t(versions, unchanged)")
def unchanged_tables(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    swapped = lambda a, b: n.select("n_nationkey", F.when(F.col("n_nationkey") == a, None).otherwise(F.col("n_name")).alias("n_name"), F.when(F.col("n_nationkey") == b, None).otherwise(F.col("n_regionkey")).alias("n_regionkey"))
    rows = [("same", K.unchanged(n, n.repartition(3))), ("a row less", K.unchanged(n, n.limit(24))), ("nulls elsewhere", K.unchanged(swapped(1, 2), swapped(2, 1))), ("another type", K.unchanged(n, n.withColumn("n_regionkey", F.col("n_regionkey").cast("double"))))]
    return spark.createDataFrame(rows, "versions string, unchanged boolean")


@query("WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS at FROM nation), b AS (SELECT n_name, n_nationkey AS at FROM nation) SELECT count(*) AS positions, count(*) FILTER (a.n_name IS DISTINCT FROM b.n_name) AS differing, count(*) FILTER (a.n_name IS DISTINCT FROM b.n_name) = 0 AS equal FROM a FULL JOIN b ON a.at = b.at")
def same_order(spark: SparkSession, d: str) -> DataFrame:
    """The same rows in the same order, by position."""
    n = table(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("at"))
    return same_sequence(numbered(n.select("n_name"), [], ["n_name"], "at").drop("total"), n, "at")


@query("""WITH a AS (SELECT 'f' || n_nationkey AS name, n_name AS hash FROM nation WHERE n_nationkey < 20), b AS (SELECT 'f' || n_nationkey AS name, CASE WHEN n_nationkey % 6 = 0 THEN 'x' ELSE n_name END AS hash FROM nation WHERE n_nationkey >= 3)
SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'NOT_RECORDED' WHEN b.name IS NULL THEN 'ABSENT' ELSE 'HASH' END AS difference FROM a FULL JOIN b ON a.name = b.name WHERE a.name IS NULL OR b.name IS NULL OR a.hash <> b.hash""")
def artifact_differences(spark: SparkSession, d: str) -> DataFrame:
    """Recorded files against those that are there, by name and digest."""
    from seqloom.operators.integrity import artifact_differences as differences

    n = table(spark, d, "nation").select(F.concat(F.lit("f"), "n_nationkey").alias("name"), "n_nationkey", F.col("n_name").alias("hash"))
    there = n.where("n_nationkey >= 3").withColumn("hash", F.when(F.col("n_nationkey") % 6 == 0, "x").otherwise(F.col("hash")))
    return differences(n.where("n_nationkey < 20"), there, "name", "hash")


_RUN = ("o_orderkey % 5 AS seed", "CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 70 - 2 END AS given", "CASE WHEN o_orderkey % 4 = 0 THEN 'wide' WHEN o_orderkey % 4 = 1 THEN '-no' END AS tag")


@query(f"""WITH r AS (SELECT {', '.join(_RUN)} FROM orders),
v AS (SELECT seed, tag, CASE WHEN given IS NULL THEN '32' WHEN given <= 0 OR (given <> 32 AND tag IS NULL) THEN 'refused' ELSE given::VARCHAR END AS batch, CASE WHEN tag IS NULL THEN 'seed_' || seed WHEN regexp_full_match(tag, '[A-Za-z0-9][A-Za-z0-9_-]*') THEN 'seed_' || seed || '_' || tag ELSE 'refused' END AS folder FROM r)
SELECT batch, folder, count(*) AS n FROM v GROUP BY batch, folder""")
def run_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings of many runs: another value than the configured one needs a run tag."""
    r = table(spark, d, "orders").selectExpr(*_RUN)
    batch = S.resolved(F.lit(32), F.col("given"), F.col("tag"), F.col("given") > 0)
    d = r.select(F.coalesce(batch.cast("string"), F.lit("refused")).alias("batch"), F.coalesce(S.run_folder(F.col("seed"), F.col("tag")), F.lit("refused")).alias("folder"))
    return d.groupBy("batch", "folder").agg(F.count(F.lit(1)).alias("n"))
