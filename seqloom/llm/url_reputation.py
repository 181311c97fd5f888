"""URL filters: fixed host rules, and empirical-Bayes host reputation for the rest.

Labelled page outcomes are counted by host, registered domain and suffix.  The share of bad
pages is shrunk from level to level: a host's prior is a beta distribution around its
domain's mean, a domain's around its suffix's, a suffix's around the overall mean.  How
strong each prior is comes from the data: the excess of the children's variance over the
binomial one (moments of the beta-binomial).  A host is blocked if the lower bound of its
posterior, without labels its prior, is above a limit.  Labelled pages are given, or else
are those that a fixed rule decides.  DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import columns, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, rule): a host with its subdomains, and the start of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: A host is blocked if posterior mean - Z * deviation is above MAX_BAD.  Strengths of priors
#: stay between the two bounds.
Z, MAX_BAD, STRENGTHS = 1.645, 0.20, (1.0, 1000.0)
#: Suffixes of two labels below which names are registered, where no longer
#: list is given.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr",
    "co.in", "gov.in", "net.in", "org.in", "com.br", "gov.br", "net.br", "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.hk", "com.tw", "com.sg", "com.my", "com.tr", "com.mx", "com.ar", "com.co", "com.pl", "com.ua", "com.ru", "co.il", "co.za", "co.id", "co.th",
)


def url_host(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z lower-cased; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.coalesce(F.when(at > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)), F.lit(""))


def site(host: Column) -> Column:
    """The host without user, port and a final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def domain(site_: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: one label more than the suffix, which is one of ``suffixes`` or
    the last label; numeric addresses are their own."""
    two, three = F.substring_index(site_, ".", -2), F.substring_index(site_, ".", -3)
    return F.when(site_.rlike(r"^[0-9.]+$"), site_).when(two.isin(*suffixes), three).otherwise(two)


def suffix(domain_: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain's suffix: two labels if they are one of ``suffixes``, else one."""
    two = F.substring_index(domain_, ".", -2)
    return F.when(domain_.rlike(r"^[0-9.]+$"), F.lit("")).when(two.isin(*suffixes), two).otherwise(F.substring_index(domain_, ".", -1))


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does, or there are none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>") if not rules else None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def _strength(children: DataFrame) -> float:
    """Prior strength from children with n, bad and their parent's mean m: rho = excess
    variance / its weight, strength = 1 / rho - 1, within STRENGTHS."""
    spread = F.col("m") * (1 - F.col("m"))
    residual = F.col("bad") - F.col("n") * F.col("m")
    row = children.agg(F.sum(residual * residual - F.col("n") * spread).alias("excess"), F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("weight")).first()
    low, high = STRENGTHS
    if not row["weight"] or row["excess"] <= 0:
        return high
    rho = row["excess"] / row["weight"]
    return min(high, max(low, 1 / rho - 1))


def host_reputation(outcomes: DataFrame, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """From pages (site, bad 0/1, null: not labelled): per site n and bad of its labelled pages,
    prior_mean, mean, lower, upper.

    A site without labelled pages has its prior as posterior.  Where its domain has no labels
    either, the domain's own share of bad pages is open too, so the prior's variance is that
    of both levels, and that of all three where the suffix has none.  Without any labelled
    page there is no prior, and no row.

    The sites' counts are stored once; levels are summed from them, each far smaller than the
    one below.  Single numbers, the overall mean and the strengths, go through the driver.
    """
    sites = outcomes.groupBy("site").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    sites = sites.withColumn("domain", domain(F.col("site"), suffixes)).withColumn("suffix", suffix(F.col("domain"), suffixes))
    sites = stored(sites, "site-outcomes")
    total = sites.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    if not total["n"]:
        sites = sites.where("false")
    overall = ((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    add_up = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    mean = lambda k: (F.col("bad") + F.lit(k) * F.col("m")) / (F.col("n") + F.lit(k))
    # 1 - variance / (m * (1 - m)) of what levels without labels leave open: k / (k + 1) a level.
    left = lambda k, above: F.when(F.col("n") > 0, 1.0).otherwise(above * F.lit(k / (k + 1)))

    ends = sites.groupBy("suffix").agg(*add_up).withColumn("m", F.lit(overall))
    k = _strength(ends)
    ends = ends.select("suffix", mean(k).alias("m"), left(k, F.lit(1.0)).alias("left"))
    domains = sites.groupBy("domain", "suffix").agg(*add_up).join(ends, "suffix")
    k = _strength(domains)
    domains = domains.select("domain", mean(k).alias("m"), left(k, F.col("left")).alias("left"))
    sites = sites.join(domains, "domain")
    k = _strength(sites)
    both = F.col("left") * F.lit(k / (k + 1))
    sites = sites.withColumn("k", F.when(F.col("left") == 1, F.lit(k)).otherwise(both / (1 - both)))
    a, b = F.col("bad") + F.col("k") * F.col("m"), F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("m"))
    sites = sites.select("site", "n", "bad", F.col("m").alias("prior_mean"), a.alias("a"), b.alias("b"))
    mean_, sd = F.col("a") / (F.col("a") + F.col("b")), F.sqrt(F.col("a") * F.col("b") / (F.col("a") + F.col("b") + 1)) / (F.col("a") + F.col("b"))
    return sites.select("site", "n", "bad", "prior_mean", mean_.alias("mean"), (mean_ - Z * sd).alias("lower"), (mean_ + Z * sd).alias("upper"))


def judge_urls(pages: DataFrame, labels: DataFrame | None = None, rules: Sequence[tuple[str, str]] = RULES, max_bad: float = MAX_BAD, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict ('allow' or 'block'), site, bad_lower (the bound;
    of the prior for hosts without a labelled page, null if no page at all is labelled).

    ``labels`` are (page_id, bad 0/1); rows with nulls don't count, several for a page count
    each.  Without ``labels`` each page that a rule decides is a labelled one, bad if blocked.
    The longest fitting rule decides; else a page is blocked if its host's lower bound is
    above ``max_bad``.  A null url, or one without ``://``, has an empty host and path; such
    pages share one site ''.  Repeated rows are judged (and, where rules label them,
    counted) each; very long urls are taken whole; an empty table gives an empty one.  Other
    columns are ignored.
    """
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    p = columns(pages, "page_id", "url").select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path")).withColumn("site", site(F.col("host")))
    p = p.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules))
    if labels is None:
        outcomes = p.select("site", (F.col("hit.verdict") == "block").cast("long").alias("bad"))
    else:
        known = columns(labels, "page_id", "bad").select(F.col("page_id").cast("long").alias("page_id"), F.col("bad").cast("long").alias("bad")).where("page_id IS NOT NULL AND bad IS NOT NULL")
        outcomes = p.select("page_id", "site").join(known, "page_id", "left")
    reputation = host_reputation(outcomes, suffixes).select("site", F.col("lower").alias("bad_lower"))
    own = F.when(F.col("bad_lower") > max_bad, "block").otherwise("allow")
    return p.join(reputation, "site", "left").select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), "site", "bad_lower")
