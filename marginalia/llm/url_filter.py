"""Operator 8: URL rules with redirect equivalence. DataFrame operations only.

Pages name other addresses of the same content by ``<link rel=canonical>`` and by ``<meta http-equiv=refresh>`` redirects; a table of
recorded redirects can be added. Connected components over these links are classes of aliases. A URL's own rule decides first. Without
one, a class that has an explicitly allowed URL is allowed, else one with a blocked URL is blocked, else the page is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from .components import connected_components

#: (verdict, host, path) of the production rules.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return shared.ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def node_of(url: Column) -> Column:
    """The key by which addresses are equal: scheme and fragment dropped, host lower-cased."""
    query = F.regexp_extract(url, "(?s)^[^?#]*(\\?[^#]*)", 1)
    return F.concat(host_of(url), path_of(url), query)


def rule_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """Rules as (verdict, rule_host, rule_path, rule)."""
    rows = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path")) for v, h, p in rules))
    return spark.range(1).select(F.inline(rows)).withColumn("rule", F.concat("rule_host", "rule_path"))


def matched(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(node, rule, own): the longest rule that fits each address (node, host, path). Suffixes of the host are joined with rule hosts."""
    labels = F.split("host", "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return (
        addresses.select("node", "path", F.explode(suffixes).alias("rule_host"))
        .join(rules, "rule_host")
        .where(F.col("path").startswith(F.col("rule_path")))
        .groupBy("node")
        .agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
        .select("node", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("own"))
    )


def alias_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(a, b, url_b) for each of a page's canonical links and redirects.

    Targets may be absolute or relative to the page: ``//host``, ``/path``, ``?query`` or a name beside it. Other schemes without ``://`` and bare
    fragments are ignored; dot segments are taken as they stand.
    """
    url, html = pages[url_col], pages[html_col]
    links, moves = (F.regexp_extract_all(html, F.lit(p), F.lit(0)) for p in (_CANONICAL, _REFRESH))
    targets = F.concat(F.transform(links, lambda x: F.regexp_extract(x, _HREF, 1)), F.transform(moves, lambda x: F.regexp_extract(x, _REFRESH_URL, 1)))
    found = pages.where(html.rlike("(?i)canonical|refresh") & url.contains("://")).select(url.alias("url"), F.explode(targets).alias("t"))
    scheme, origin = F.regexp_extract("url", "^([^:/?#]*):", 1), F.regexp_extract("url", "(?s)^(.*?://[^/?#]*)", 1)
    to = (
        F.when(F.col("t").contains("://"), F.col("t"))
        .when(F.col("t").startswith("//"), F.concat(scheme, F.lit(":"), F.col("t")))
        .when(F.col("t").startswith("/"), F.concat(origin, F.col("t")))
        .when(F.col("t").startswith("?"), F.concat(origin, path_of(F.col("url")), F.col("t")))
        .when(F.col("t").rlike("^[^#:?/]+([/?#]|$)"), F.concat(origin, F.regexp_replace(path_of(F.col("url")), "(?s)[^/]*$", ""), F.when(path_of(F.col("url")) == "", "/").otherwise(""), F.col("t")))
    )
    return found.select("url", to.alias("url_b")).where("url_b is not null").select(node_of(F.col("url")).alias("a"), node_of(F.col("url_b")).alias("b"), "url_b")


def judged(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return (id, host, path, rule, verdict) for each row of ``pages``.

    ``redirects`` may add (source, target) URLs. Null URLs and those without ``://`` have an empty host and path, no rule and no aliases, and
    are allowed. Ties of equally long rules go to the greater rule text, then verdict. Repeated pages each get a row. An empty table gives an
    empty one. Only the named columns are read, and ``html`` only for its links.
    """
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    links = alias_links(pages, url_col, html_col)
    if redirects is not None:
        links = links.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b"), F.col("target").alias("url_b")))
    links = shared.stored(links.where("a <> '' and b <> '' and a <> b").distinct(), "aliases")
    light = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"), F.coalesce(node_of(pages[url_col]), F.lit("")).alias("node"))
    addresses = light.select("node", "host", "path").unionByName(
        links.select(F.col("b").alias("node"), host_of(F.col("url_b")).alias("host"), path_of(F.col("url_b")).alias("path"))
    )
    own = shared.stored(matched(addresses.where("host <> ''").distinct(), rules), "ruled")
    classes = connected_components(links)
    classes = shared.stored(classes, "classes")
    marks = classes.join(own, "node").groupBy("component").agg(F.max(F.col("own") == "allow").alias("any_allow"), F.max(F.col("own") == "block").alias("any_block"))
    decided = (
        classes.join(shared.stored(marks, "marks"), "component")
        .select("node", (F.col("any_block") & ~F.col("any_allow")).alias("spread"))
    )
    return (
        light.join(own, "node", "left")
        .join(decided, "node", "left")
        .select(
            F.col("id").alias(id_col),
            "host",
            "path",
            "rule",
            F.coalesce("own", F.when(F.col("spread"), F.lit("block")), F.lit("allow")).alias("verdict"),
        )
    )


def kept_pages(pages: DataFrame, **named) -> DataFrame:
    """``pages``, all columns, without blocked rows.

    Rows are judged by their URL, so of rows that share an id, or have none, only the blocked ones go. Null URLs stay, repeated rows share their fate,
    an empty table gives an empty one.
    """
    url = named.get("url_col", "url")
    judged_urls = judged(pages.select(pages[url].alias("page_id"), pages[url].alias("url"), pages[named.get("html_col", "html")].alias("html")), named.get("rules"), named.get("redirects"))
    blocked = judged_urls.where("verdict = 'block'").select(F.col("page_id").alias("_blocked")).distinct()
    return pages.join(blocked, pages[url] == blocked["_blocked"], "left_anti")


#: DuckDB SQL of the production query.
ORACLE = r"""
WITH RECURSIVE page AS (
  SELECT page_id, url, html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
target AS (
  SELECT url, path, unnest(list_concat(
    list_transform(regexp_extract_all(html, '(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
    list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1)))) AS t
  FROM page WHERE contains(url, '://')),
resolved AS (
  SELECT url, CASE WHEN contains(t, '://') THEN t
                   WHEN starts_with(t, '//') THEN regexp_extract(url, '^([^:/?#]*):', 1) || ':' || t
                   WHEN starts_with(t, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || t
                   WHEN starts_with(t, '?') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || path || t
                   WHEN regexp_matches(t, '^[^#:?/]+([/?#]|$)')
                     THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || regexp_replace(path, '(?s)[^/]*$', '') || CASE WHEN path = '' THEN '/' ELSE '' END || t END AS url_b
  FROM target WHERE t <> ''),
address AS (
  SELECT url FROM page WHERE contains(url, '://') UNION SELECT url_b FROM resolved WHERE url_b IS NOT NULL),
part AS (
  SELECT url, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path, regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1) AS query
  FROM address),
node AS (SELECT url, host, path, host || path || query AS node FROM part),
own AS (
  SELECT url, node, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS own
  FROM node LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY url, node),
edge AS (
  SELECT a.node AS a, b.node AS b FROM resolved r JOIN node a ON a.url = r.url JOIN node b ON b.url = r.url_b WHERE a.node <> b.node
  UNION SELECT b.node, a.node FROM resolved r JOIN node a ON a.url = r.url JOIN node b ON b.url = r.url_b WHERE a.node <> b.node),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b),
spread AS (
  SELECT r.a AS node, bool_or(o.own = 'block') AND NOT coalesce(bool_or(o.own = 'allow'), false) AS spread
  FROM reach r JOIN own o ON o.node = r.b WHERE o.own IS NOT NULL GROUP BY r.a)
SELECT page_id, host, path, o.rule, coalesce(o.own, CASE WHEN s.spread THEN 'block' END, 'allow') AS verdict
FROM page p LEFT JOIN own o ON o.url = p.url LEFT JOIN spread s ON s.node = o.node
"""
