"""URL filters with redirect equivalence, in DataFrame operations only.

Rules decide the urls that they fit. Redirect and canonical-link edges tie urls to their aliases; a decision
spreads over the connected component of the url: a page that no rule fits is blocked if a rule blocks an alias
and none allows one, and allowed otherwise. Edges come from ``<link rel=canonical>``, ``<meta refresh>`` and
``og:url`` in the page; urls that differ only in scheme, fragment or tracking parameters are one node.

Null urls and urls without ``://`` have empty host and path, fit no rule, have no aliases and are allowed.
Repeated rows are judged each. All links of a page count; relative ones are resolved against its url.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import save, table
from tideline.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the query's rules; fixed values.
RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)

CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
OG_URL = r"""(?is)<meta\b[^>]*\bproperty\s*=\s*["']?og:url\b[^>]*>"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
CONTENT = r"""(?is)\bcontent\s*=\s*["']?([^"'\s>]+)"""
REFRESH_URL = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
TRACKING = r"(?:^|&)(?:utm_[^=&]*|ref|fbclid|gclid)(?:=[^&]*)?(?=&|$)"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule that fits, or null; of equally long ones, allow.

    ``rules`` is a bounded list, held in the expression; :func:`fitting_rules` joins lists of any length.
    """
    each = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(int(v == "allow")).alias("allow"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for h, p, v in rules
    ]
    return F.array_max(F.array(*each)) if each else F.lit(None).cast("struct<length:int,allow:int,rule:string,verdict:string>")


def fitting_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``id, rule, verdict`` for ``urls`` (``id, host, path``) by a join with ``rules`` (``host, path, verdict``):
    each url is posted under the suffixes of its host. Ids without a fitting rule are absent."""
    labels = F.split("host", "\\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    posted = urls.select("id", "path", F.explode(suffix).alias("_host"))
    r = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), "verdict")
    fits = posted.join(r, "_host").where(F.expr("startswith(path, _path)"))
    rule = F.concat("_host", "_path")
    best = fits.groupBy("id").agg(F.max(F.struct(F.length(rule).alias("length"), (F.col("verdict") == "allow").cast("int").alias("allow"), rule.alias("rule"), "verdict")).alias("b"))
    return best.select("id", "b.rule", "b.verdict")


def node_of(url: Column) -> Column:
    """The url's node: md5 of host, path without a last slash, and query without tracking; null without ``://``."""
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), TRACKING, "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(url.contains("://"), F.md5(F.concat_ws("\n", host_of(url), path, F.regexp_replace(query, "^&", "")).cast("binary")))


def decoded(text: Column) -> Column:
    """The text with its numeric entities and the five named ones of XML decoded."""

    def one(part: Column, i: Column) -> Column:
        hexed = F.conv(F.regexp_extract(part, r"^[xX]([0-9a-fA-F]{1,6});", 1), 16, 16)
        hexed = F.when(part.rlike(r"^[xX][0-9a-fA-F]{1,6};"), hexed).when(part.rlike(r"^\d{1,7};"), F.conv(F.regexp_extract(part, r"^(\d{1,7});", 1), 10, 16))
        char = F.decode(F.unhex(F.lpad(hexed, 8, "0")), "UTF-32")
        known = hexed.isNotNull() & (F.conv(hexed, 16, 10).cast("long") <= 0x10FFFF)
        return F.when(i == 0, part).when(known, F.concat(char, F.regexp_replace(part, "^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), part))

    text = F.when(text.contains("&#"), F.array_join(F.transform(F.split(text, "&#"), one), "")).otherwise(text)
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def without_dots(path: Column) -> Column:
    """The absolute path without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    push = lambda done, x: F.when(x == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), push)
    open_ = F.element_at(parts, -1).isin(".", "..")
    return F.array_join(F.when(open_, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolved(link: Column, url: Column) -> Column:
    """The link as an absolute url; null for schemes without ``://``, and for relative links of a url without it."""
    origin = F.regexp_extract(url, r"(?s)^(.*?)://([^/?#]*)", 0)
    scheme = F.regexp_extract(url, r"(?s)^(.*?:)//", 1)
    own, rest = F.regexp_extract(link, r"(?s)^[^?#]*", 0), F.regexp_extract(link, r"(?s)^[^?#]*(.*)", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path_of(url), r"(?s)^/(.*/)?", 1))
    path = F.when(own == "", path_of(url)).otherwise(without_dots(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when((link == "") | (origin == "") | link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(link.startswith("//"), F.concat(scheme, link)).otherwise(F.concat(origin, path, rest))
    )


def _value(pattern: str):
    return lambda tag: F.regexp_extract(tag, pattern, 1)


def links_of(html: Column, url: Column) -> Column:
    """The absolute targets of all canonical, og:url and refresh tags of a page."""
    found = [
        F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), _value(value))
        for tag, value in ((CANONICAL, HREF), (OG_URL, CONTENT), (REFRESH, REFRESH_URL))
    ]
    links = F.coalesce(F.concat(*found), F.array().cast("array<string>"))
    return F.array_compact(F.transform(links, lambda x: resolved(decoded(x), url)))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, node, component`` of each page."""
    url = F.col("url")
    p = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node"), links_of(F.col("html"), url).alias("links"))
    p = save(p.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "node", "links", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("decided")), "urls")
    out = p.where(F.size("links") > 0).select("node", F.explode("links").alias("link"))
    goal = F.col("link")
    out = save(out.select("node", node_of(goal).alias("other"), fitting_rule(host_of(goal), path_of(goal), rules)["verdict"].alias("decided")), "links")
    component = connected_components(out, "node", "other")
    known = p.select("node", "decided").union(out.select(F.col("other").alias("node"), "decided")).where("node is not null and decided is not null")
    named = F.coalesce("component", "node")
    by = known.join(component, "node", "left").groupBy(named.alias("component")).agg(F.max((F.col("decided") == "allow")).alias("allowed"), F.max((F.col("decided") == "block")).alias("blocked"))
    bad = by.where("blocked and not allowed").select("component", F.lit(True).alias("bad"))
    mine = p.join(component, "node", "left").withColumn("component", named).join(bad, "component", "left")
    verdict = F.coalesce("decided", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow")))
    return mine.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "node", "component")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql_url(url: str) -> tuple[str, str, str]:
    """Host, path and node of a url expression in DuckDB."""
    host = rf"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '')"
    path = rf"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"
    query = rf"regexp_extract({url}, '(?s)^[^?#]*\?([^#]*)', 1)"
    for name in ("utm_[^=&]*", "ref", "fbclid", "gclid"):  # RE2 has no look-ahead: close each parameter with its own &
        query = rf"regexp_replace('&' || {query} || '&', '&{name}(=[^&]*)?', '', 'g')"
        query = rf"trim({query}, '&')"
    node = rf"CASE WHEN contains({url}, '://') THEN {host} || chr(10) || regexp_replace({path}, '/+$', '') || chr(10) || {query} END"
    return host, path, node


def _sql_fit(host: str, path: str, what: str) -> str:
    rows = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow"))
    value = {"rule": lambda r: r[0] + r[1], "verdict": lambda r: r[2]}[what]
    return "CASE " + " ".join(f"WHEN ({host} = '{r[0]}' OR suffix({host}, '.{r[0]}')) AND prefix({path}, '{r[1]}') THEN '{value(r)}'" for r in rows) + " END"


def _oracle() -> str:
    h, p, n = _sql_url("url")
    gh, gp, gn = _sql_url("link")
    q = lambda s: s.replace("'", "''")
    found = [
        f"regexp_extract(regexp_extract(html, '{q(CANONICAL)}', 0), '{q(HREF)}', 1)",
        f"regexp_extract(regexp_extract(html, '{q(OG_URL)}', 0), '{q(CONTENT)}', 1)",
        f"regexp_extract(regexp_extract(html, '{q(REFRESH)}', 0), '{q(REFRESH_URL)}', 1)",
    ]
    return rf"""
WITH RECURSIVE p AS (SELECT page_id, url, html, {h} AS host, {p} AS path, {n} AS node FROM pages),
f AS (SELECT *, {_sql_fit("host", "path", "rule")} AS rule, {_sql_fit("host", "path", "verdict")} AS decided FROM p),
x AS (SELECT node, url, unnest([{", ".join(found)}]) AS x FROM p WHERE html IS NOT NULL),
y AS (SELECT node, CASE WHEN contains(x, '://') THEN x WHEN prefix(x, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || x
             WHEN prefix(x, '/') THEN regexp_extract(url, '(?s)^(.*?)://([^/?#]*)', 0) || x END AS link FROM x),
g AS (SELECT node, link, {gh} AS host, {gp} AS path, {gn} AS other FROM y WHERE link IS NOT NULL),
e AS (SELECT node, other FROM g WHERE node IS NOT NULL AND other IS NOT NULL UNION SELECT other, node FROM g WHERE node IS NOT NULL AND other IS NOT NULL),
known AS (SELECT node, decided FROM f UNION ALL SELECT other, {_sql_fit("host", "path", "verdict")} FROM g),
reach AS (SELECT DISTINCT node AS root, node FROM e UNION SELECT reach.root, e.other FROM reach JOIN e ON reach.node = e.node),
alias AS (SELECT node AS root, node FROM known WHERE node IS NOT NULL UNION SELECT root, node FROM reach),
d AS (SELECT alias.root, bool_or(decided = 'allow') AS allowed, bool_or(decided = 'block') AS blocked
      FROM alias JOIN known ON alias.node = known.node GROUP BY alias.root)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN d.blocked AND NOT coalesce(d.allowed, false) THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN d ON f.node = d.root
"""


ORACLE = _oracle()
QUERIES = {"op7_url_filter": op7_url_filter}
ORACLES = {"op7_url_filter": ORACLE}
