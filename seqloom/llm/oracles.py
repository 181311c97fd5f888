r"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
s AS (SELECT rid, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d),
k AS (SELECT rid, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM s),
r AS (SELECT rid, i FROM k WHERE k IN (SELECT k FROM k GROUP BY k HAVING count(*) > 1)),
c AS (SELECT DISTINCT rid, i + j AS p FROM r, (SELECT unnest(range(0, 35)) AS j)),
x AS (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
a AS (SELECT x.rid, count(c.p) AS n_removed, string_agg(x.word, ' ' ORDER BY x.p) FILTER (c.p IS NULL) AS kept
      FROM x LEFT JOIN c ON x.rid = c.rid AND x.p = c.p GROUP BY x.rid)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(a.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM d LEFT JOIN a ON d.rid = a.rid
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rules() -> tuple[str, str]:
    from .url_reputation import RULES

    rule, verdict = [], []
    for v, r in sorted(RULES, key=lambda x: -len(x[1])):
        host, _, path = r.partition("/")
        fits = f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"
        rule.append(f"{fits} THEN '{r}'")
        verdict.append(f"{fits} THEN '{v}'")
    return " ".join(rule), " ".join(verdict)


def _op4() -> str:
    """Levels without labelled pages have n = 0: their mean is their parent's, and ``open`` is
    the product of k / (k + 1) over such levels, 1 where the domain has labels."""
    from .url_reputation import MAX_BAD, STRENGTHS, SUFFIXES, Z

    low, high = STRENGTHS
    rule, verdict = _rules()
    strength = f"(SELECT CASE WHEN coalesce(w, 0) = 0 OR e <= 0 THEN {high} ELSE least({high}, greatest({low}, 1 / (e / w) - 1)) END FROM (SELECT sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) AS e, sum(n * (n - 1) * m * (1 - m)) AS w FROM %s))"
    known = ", ".join(f"'{x}'" for x in SUFFIXES)
    two = r"regexp_extract(%s, '([^.]*\.)?[^.]*$', 0)"
    return rf"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
p AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS site, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM h),
o AS (SELECT site, count(ruled) AS n, coalesce(sum(CASE WHEN ruled = 'block' THEN 1 WHEN ruled = 'allow' THEN 0 END), 0)::DOUBLE AS bad FROM p GROUP BY site),
s AS (SELECT *, CASE WHEN regexp_matches(site, '^[0-9.]+$') THEN site WHEN {two % 'site'} IN ({known}) THEN regexp_extract(site, '([^.]*\.)?[^.]*\.[^.]*$', 0) ELSE {two % 'site'} END AS dom FROM o),
t AS (SELECT *, CASE WHEN regexp_matches(dom, '^[0-9.]+$') THEN '' WHEN {two % 'dom'} IN ({known}) THEN {two % 'dom'} ELSE regexp_extract(dom, '[^.]*$', 0) END AS suf FROM s),
a0 AS (SELECT suf, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1.0::DOUBLE) FROM t) AS m FROM t GROUP BY suf),
a AS (SELECT suf, (bad + k * m) / (n + k) AS m, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE k / (k + 1) END AS open FROM (SELECT *, {strength % 'a0'}::DOUBLE AS k FROM a0)),
b0 AS (SELECT t.dom, a.m, a.open, sum(t.n) AS n, sum(t.bad) AS bad FROM t JOIN a ON t.suf = a.suf GROUP BY t.dom, a.m, a.open),
b AS (SELECT dom, (bad + k * m) / (n + k) AS m, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE open * (k / (k + 1)) END AS open FROM (SELECT *, {strength % 'b0'}::DOUBLE AS k FROM b0)),
c0 AS (SELECT t.site, t.n, t.bad, b.m, b.open FROM t JOIN b ON t.dom = b.dom),
c1 AS (SELECT *, {strength % 'c0'}::DOUBLE AS k FROM c0),
c2 AS (SELECT * REPLACE (CASE WHEN open = 1 THEN k ELSE open * (k / (k + 1)) / (1 - open * (k / (k + 1))) END AS k) FROM c1),
c AS (SELECT site, bad + k * m AS x, n - bad + k * (1 - m) AS y FROM c2 WHERE (SELECT sum(n) FROM t) > 0),
r AS (SELECT site, x / (x + y) - {Z} * sqrt(x * y / (x + y + 1)) / (x + y) AS lower FROM c)
SELECT page_id, host, path, rule, CASE WHEN ruled IS NOT NULL THEN ruled WHEN r.lower > {MAX_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN r ON p.site = r.site
"""


OP5 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = d.doc_id
"""


def _op10() -> str:
    """A block is any stretch of words up to the width; one that holds the most of a template's
    words can start at one of them."""
    from .licenses import PHRASES, TEMPLATES, THRESHOLD, needed, width

    def listed(t: str) -> str:
        return "[" + ", ".join(f"'{w}'" for w in t.split()) + "]"

    places, names, best, met, shares = [], [], [], [], []
    for label, phrase in PHRASES:
        k = len(phrase.split())
        places.append(f"list_transform(list_filter(range(1, len(w) - {k} + 2), lambda i: w[i:i + {k - 1}] = {listed(phrase)}), lambda i: i - 1)")
        names.append(label)
    for j, (label, t) in enumerate(TEMPLATES):
        size = len(set(t.split()))
        need, wide = needed(size, THRESHOLD), width(len(t.split()), THRESHOLD)
        inside = f"len(list_distinct(list_intersect(w[i:i + {wide - 1}], {listed(t)})))"
        most = f"list_max(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_contains({listed(t)}, w[i])), lambda i: {inside}))"
        best.append(f"CASE WHEN len(list_distinct(list_intersect(w, {listed(t)}))) >= {need} THEN {most} ELSE 0 END AS b{j}")
        met.append(f"CASE WHEN b{j} >= {need} THEN '{label}' END")
        shares.append(f"CASE WHEN b{j} >= {need} THEN b{j} / {size}::DOUBLE ELSE 0 END")
    base = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{n}' END" for i, n in enumerate(names))
    count = " + ".join(f"len(p{i})" for i in range(len(names)))
    low = ", ".join(f"list_min(p{i})" for i in range(len(names)))
    high = ", ".join(f"list_max(p{i})" for i in range(len(names)))
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter([{x}], lambda v: v IS NOT NULL))), ',')"
    return rf"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM t),
p AS (SELECT doc_id, w, {', '.join(f'{x} AS p{i}' for i, x in enumerate(places))}, {', '.join(best)} FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, ({count})::BIGINT AS n_base, least({low})::BIGINT AS first_word, greatest({high})::BIGINT AS last_word,
  {joined(base)} AS base_labels, {joined(base + ', ' + ', '.join(met))} AS labels,
  CASE WHEN {count} > 0 THEN 1.0::DOUBLE ELSE greatest({', '.join(shares)})::DOUBLE END AS score
FROM p
"""


#: CRC-32 of a decimal, bit by bit: a character is added (its code), then eight shifts (-1).
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({x}::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a // 2, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295::BIGINT)"""

OP11 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 100 AS b, {_CRC32.format(x="conv_id")} % 6 AS h FROM t),
u AS (SELECT c, md5(r) || md5(x) AS k, length(x) AS n, 0 AS own, p FROM c JOIN t ON t.conv_id = b AND p <= h
  UNION ALL SELECT c, md5(r) || md5(x), length(x), 1, p FROM c JOIN t ON t.conv_id = c AND p > h),
l AS (SELECT c.c, coalesce(list(k ORDER BY own, p) FILTER (k IS NOT NULL), []) AS k, coalesce(list(n ORDER BY own, p) FILTER (k IS NOT NULL), []) AS n FROM c LEFT JOIN u ON u.c = c.c GROUP BY c.c),
e AS (SELECT c, d, len(k) = d AS ends, md5(array_to_string(k[1:d], '')) AS node, md5(array_to_string(k[1:d - 1], '')) AS above, CASE WHEN d = 0 THEN 0 ELSE n[d] END AS chars
  FROM (SELECT *, unnest(range(0, len(k) + 1)) AS d FROM l)),
g AS (SELECT d, node, min(above) AS above, min(c) AS conv_id, count(*) AS members, (count(*) - 1) * min(chars) AS saved, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends FROM e GROUP BY d, node),
k AS (SELECT d - 1 AS d, above AS node, count(*) AS children FROM g WHERE d > 0 GROUP BY ALL),
s AS (SELECT e.d, e.node, count(*) FILTER (k.children IS NULL) AS leaves, sum(g.saved) AS saved
  FROM g LEFT JOIN k ON k.d = g.d AND k.node = g.node JOIN e ON e.c = g.conv_id AND e.d <= g.d GROUP BY e.d, e.node)
SELECT g.conv_id, g.d::BIGINT AS depth, q.conv_id AS parent_conv_id, g.members::BIGINT AS n_convs, coalesce(k.children, 0)::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, g.ends AS ends_sha256
FROM g JOIN s ON s.d = g.d AND s.node = g.node LEFT JOIN k ON k.d = g.d AND k.node = g.node LEFT JOIN g q ON q.d = g.d - 1 AND q.node = g.above
"""


def _op12() -> str:
    """Places of matches follow from the lengths of the matches and of what stands between them;
    entropy is that of each window of each candidate by itself."""
    from .secret_scan import ALLOWED_WHOLE, CLASSES, LEAST_ACCESS, LEAST_VALUE, WINDOW

    either = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join(either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    patterns = {
        "assign": rf"({names})[\x22\x27]?\x20*[:=]\x20*[\x22\x27]?([A-Za-z0-9+/_.=-]+)",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]+",
        "entropy": f"[A-Za-z0-9+/=_-]{{{WINDOW},}}",
    }
    least = {"assign": f"length(v) >= {LEAST_VALUE}", "access": f"length(w) >= {LEAST_ACCESS}", "hex": "length(w) >= 32"}
    found = " UNION ALL ".join(
        f"SELECT rid, t, '{k}' AS kind, {i} AS o, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {2 if k == 'assign' else 0}) AS g, regexp_split_to_array(t, '{p}') AS s FROM d WHERE regexp_matches(t, '{p}')"
        for i, (k, p) in enumerate(patterns.items())
    )
    known = " OR ".join(f"(kind = '{k}' AND {c})" for k, c in least.items())
    whole = "|".join(f"(?:{x.decode()})" for x in ALLOWED_WHOLE)
    repeated = "|".join(f"{c}{{8}}" for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
    parts = [r"(?i:example|sample|dummy|placeholder|change_?me|redacted|your[-_]?(?:api|key|token|secret))", "(?i:abcdefgh|qwertyui|01234567|12345678)", f"(?:{repeated})", r"\A/*sha(?:1|256|384|512)-"]
    allowed = f"regexp_full_match(w, '{whole}') OR regexp_matches(w, '{'|'.join(parts)}') OR ends_with(substr(t, 1, start), ';base64,')"
    sets = {"hexadecimal": "[0-9A-Fa-f]+", "upper": "[0-9A-Z]+", "base64": "[0-9A-Za-z+/=_-]+"}
    high = " OR ".join(f"(regexp_full_match(x, '{sets[c.name]}') AND h >= {c.bound} - 1e-9)" for c in CLASSES)
    entropy = f"log2({WINDOW}) - list_sum(list_transform(map_values(list_histogram(string_split(x, ''))), lambda n: n * log2(n))) / {WINDOW}"
    listed = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, o, stop)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({found}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM m),
q AS (SELECT rid, t, kind, o, m[i] AS w, g[i] AS v, (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM i WHERE kind <> 'hex' OR length(m[i]) >= 32),
b AS (SELECT rid, kind, o, start, start + length(w) AS stop FROM q WHERE {known}),
c AS (SELECT rid, start, w FROM q WHERE kind = 'entropy' AND NOT ({allowed})),
n AS (SELECT rid, start + j AS pos, w[j + 1:j + {WINDOW}] AS x FROM (SELECT *, unnest(range(0, length(w) - {WINDOW - 1})) AS j FROM c)),
h AS (SELECT rid, pos FROM (SELECT rid, pos, x, {entropy} AS h FROM n WHERE regexp_matches(x, '[0-9]') AND regexp_matches(x, '[A-Za-z]')) WHERE {high}),
e AS (SELECT rid, pos, pos - coalesce(lag(pos) OVER w, -1000) > {WINDOW} AS new FROM h WINDOW w AS (PARTITION BY rid ORDER BY pos)),
f AS (SELECT rid, pos, sum(new::INTEGER) OVER (PARTITION BY rid ORDER BY pos) AS k FROM e),
r AS (SELECT rid, 'entropy' AS kind, 3 AS o, min(pos) AS start, max(pos) + {WINDOW} AS stop FROM f GROUP BY rid, k),
a AS (SELECT * FROM b UNION ALL SELECT r.* FROM r WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.rid = r.rid AND b.start <= r.start AND b.stop >= r.stop)),
z AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {listed} FILTER (o < 3) AS base, {listed} AS spans FROM a GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z ON z.rid = d.rid
"""


def _op13() -> str:
    """Every order's steps are counted from the documents' failures one by one."""
    fails = {
        "a": "n < 100",
        "b": "100 * len(list_distinct(w)) < 80 * n",
        "c": "100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t)",
        "d": "regexp_matches(t, '[#$%&*|]')",
        "e": "doc_id IS NOT NULL AND doc_id > min(doc_id) OVER (PARTITION BY t)",
    }
    flags = ", ".join(f"coalesce({c}, false)" for c in fails.values())
    return rf"""
WITH m AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS bad FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w, len(w) AS n FROM documents),
f AS (SELECT doc_id, part, [{flags}] AS f FROM d),
g AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM f LEFT JOIN m USING (doc_id) GROUP BY part, f),
l AS (SELECT unnest(range(1, 6)) AS x),
o AS (SELECT [a.x, b.x, c.x, d.x, e.x] AS o FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT o, array_to_string(list_transform(o, lambda i: chr(64 + i::INT)), '') AS filter_order, x AS step, o[x] AS own, o[1:x - 1] AS earlier FROM o, l),
r AS (SELECT part, filter_order, step, own, n, good, bad, f[own] AS hit, len(list_filter(earlier, lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda v: v)) AS fails FROM g, s),
z AS (SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT hit), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND hit), 0) AS removed, coalesce(sum(n) FILTER (gone AND hit), 0) AS redundant,
    coalesce(sum(n) FILTER (hit AND fails = 1), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND hit), 0) AS good_lost, coalesce(sum(bad) FILTER (NOT gone AND hit), 0) AS toxic_lost
  FROM r GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM z
"""


ORACLES: dict[str, str] = {"op1_substring_dedup": OP1, "op4_url_reputation": _op4(), "op5_jaccard_join": OP5, "op10_license_scan": _op10(), "op11_prefix_trie": OP11, "op12_secret_scan": _op12(), "op13_filter_audit": _op13()}
