from pyspark.sql import functions as F

from seqloom.llm import url_reputation as U

CASES = [
    ("https://A.Example.ORG/es/1", "a.example.org", "/es/1", "example.org/es/", "block"),
    ("http://x.org/en/12", "x.org", "/en/12", "org/", "allow"),
    ("http://example.org/en/12?q=://z", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://notexample.org/es/1", "notexample.org", "/es/1", "org/", "allow"),
    ("http://a.com/fr/x#y", "a.com", "/fr/x", "com/fr/", "allow"),
    ("http://a.com/de/", "a.com", "/de/", "com/de/", "block"),
    ("http://a.com", "a.com", "", None, "allow"),
    ("http://org", "org", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("://", "", "", None, "allow"),
    ("http:///org/", "", "/org/", None, "allow"),
    ("ftp://u@H.net:80/a\nb?c", "u@h.net:80", "/a\nb", None, "allow"),
    ("x://É.ORG/", "É.org", "/", "org/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, c[0], "html", "host") for i, c in enumerate(CASES)], "page_id long, url string, html string, host string")
    none = spark.createDataFrame([], "page_id long, bad long")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages, none).collect()}
    assert got == {i: c[1:] for i, c in enumerate(CASES)}
    assert U.judge_urls(pages.limit(0), none).count() == 0


def test_sites_and_domains(spark):
    names = ["a.b.example.net", "example.net:8080", "u:p@www.x.com.", "10.0.0.1", "localhost", ""]
    d = spark.createDataFrame([(n,) for n in names], "h string").select(U.site(F.col("h")).alias("s"))
    got = [(r.s, r.d, r.x) for r in d.select("s", U.domain(F.col("s")).alias("d")).select("s", "d", U.suffix(F.col("d")).alias("x")).collect()]
    assert got == [("a.b.example.net", "example.net", "net"), ("example.net", "example.net", "net"), ("www.x.com", "x.com", "com"), ("10.0.0.1", "10.0.0.1", ""), ("localhost", "localhost", "localhost"), ("", "", "")]


def test_reputation_shrinks_and_blocks(spark):
    rows, labels, i = [], [], 0
    for host, n, bad in (("bad.evil.net", 200, 180), ("ok.good.net", 200, 10), ("tiny.good.net", 2, 2), ("new.evil.net", 3, 0), ("fine.other.com", 100, 4)):
        for j in range(n):
            rows.append((i, f"http://{host}/p"))
            labels.append((i, int(j < bad)))
            i += 1
    rows.append((i, "http://unseen.net/p"))
    labels += [(None, 1), (0, None), (10**9, 1)]
    pages, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad long")
    got = {(r.host, r.verdict) for r in U.judge_urls(pages, lab).select("host", "verdict").distinct().collect()}
    assert ("bad.evil.net", "block") in got and {h for h, v in got if v == "block"} <= {"bad.evil.net", "new.evil.net"}
    rep = {r.site: r for r in U.host_reputation(pages.join(lab, "page_id").select(U.url_host(F.col("url")).alias("site"), "bad").where("bad IS NOT NULL")).collect()}
    assert rep["tiny.good.net"].mean < 1.0 and rep["tiny.good.net"].lower < rep["tiny.good.net"].mean < rep["tiny.good.net"].upper
    assert rep["bad.evil.net"].n == 200 and rep["bad.evil.net"].bad == 180


def test_hosts_without_labels_take_their_domains_prior(spark):
    rows, labels, i = [], [], 0
    for name, share in (("evil.net", 1.0), ("good.net", 0.0), ("fine.com", 0.05), ("calm.com", 0.05)):
        for h in range(5):
            for j in range(40):
                rows.append((i, f"http://h{h}.{name}/p"))
                labels.append((i, int(j < 40 * share)))
                i += 1
    fresh = ["new.evil.net", "new.good.net", "new.fine.com", "a.unseen.net", "a.unseen.xyz"]
    rows += [(i + j, f"http://{h}/p") for j, h in enumerate(fresh)]
    pages, lab = spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad long")
    got = {r.host: r for r in U.judge_urls(pages, lab).collect()}
    assert {h: got[h].verdict for h in fresh} == {h: "block" if h == "new.evil.net" else "allow" for h in fresh}
    assert all(got[h].bad_lower is not None for h in fresh)
    assert got["new.evil.net"].bad_lower < got["h0.evil.net"].bad_lower and got["a.unseen.net"].bad_lower < got["new.evil.net"].bad_lower
    with_fresh = {r.host: r.bad_lower for r in U.judge_urls(pages.where(f"page_id < {i}"), lab).collect()}
    assert all(abs(got[h].bad_lower - x) < 1e-12 for h, x in with_fresh.items())


def test_pages_that_rules_decide_are_labels(spark):
    """Without labels: of two.com every page is blocked by rule, so its other pages go too."""
    rows = [(i, f"http://a{i % 3}.two.com/de/{i}") for i in range(60)] + [(100 + i, f"http://b.fine.com/fr/{i}") for i in range(60)]
    rows += [(900, "http://a0.two.com/en/1"), (901, "http://new.two.com/en/1"), (902, "http://b.fine.com/en/1"), (903, "http://x.y.net/en/1")]
    got = {r.page_id: r.verdict for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).where("rule IS NULL").collect()}
    assert got == {900: "block", 901: "block", 902: "allow", 903: "allow"}


def test_suffixes_of_two_labels(spark):
    d = spark.createDataFrame([("a.b.shop.co.uk",), ("shop.co.uk",), ("co.uk",), ("uk",), ("x.com.au",), ("a.b.com",)], "h string")
    got = [(r.d, r.x) for r in d.select(U.domain(F.col("h")).alias("d")).select("d", U.suffix(F.col("d")).alias("x")).collect()]
    assert got == [("shop.co.uk", "co.uk"), ("shop.co.uk", "co.uk"), ("co.uk", "co.uk"), ("uk", "uk"), ("x.com.au", "com.au"), ("b.com", "com")]
    one = d.select(U.domain(F.col("h"), ["b.com"]).alias("d")).collect()[-1].d
    assert one == "a.b.com"


def test_no_python_on_the_executors(spark):
    p = spark.createDataFrame([(1, "http://a.b/")], "page_id long, url string")
    plan = U.judge_urls(p, spark.createDataFrame([(1, 1)], "page_id long, bad long"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_without_rules_only_reputation_decides(spark):
    rows = [(i, f"http://a.bad.com/{i}") for i in range(40)] + [(100 + i, f"http://b.fine.org/{i}") for i in range(40)]
    labels = spark.createDataFrame([(i, int(i < 40)) for i, _ in rows], "page_id long, bad long")
    got = U.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), labels, rules=()).collect()
    assert all(r.rule is None for r in got) and {(r.host, r.verdict) for r in got} == {("a.bad.com", "block"), ("b.fine.org", "allow")}


def test_empty_tables_repeated_rows_and_other_columns(spark):
    schema = "page_id long, url string, host string, site string, bad long, n long, domain string, hit string, bad_lower double"
    rows = [(1, "http://x.com/de/1", "h", "s", 7, 7, "d", "t", 0.5)] * 3 + [(2, None, None, None, None, None, None, None, None), (None, "http://x.com/en", "h", "s", 7, 7, "d", "t", 0.5), (3, "http://" + "a" * 200_000 + ".com/", "", "", 0, 0, "", "", 0.0)]
    pages = spark.createDataFrame(rows, schema)
    got = [(r.page_id, r.rule, r.verdict) for r in U.judge_urls(pages).orderBy("page_id").collect()]
    assert got[1:4] == [(1, "com/de/", "block")] * 3 and len(got) == 6
    plain = sorted(map(str, U.judge_urls(pages.select("page_id", "url")).collect()))
    assert plain == sorted(map(str, U.judge_urls(pages).collect()))
    assert U.judge_urls(pages.limit(0)).count() == 0
    none = spark.createDataFrame([], "page_id long, bad long")
    assert {(r.verdict, r.bad_lower) for r in U.judge_urls(pages, none).where("rule IS NULL").collect()} == {("allow", None)}
