"""URL filters whose decisions reach the aliases of a page.

A page's own rule decides first: the longest rule that fits its host and path. Pages without one
take the decision of their aliases, the connected component over redirects and canonical links:
a component with an explicitly allowed URL is allowed, else one with a blocked URL is blocked,
else it is allowed. So an explicit allow goes before a block, both on the URL and among aliases.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import components, settle, table


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _order(rules) -> list[Rule]:
    return sorted(rules, key=lambda r: (-len(r.name), r.name))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """The name of the longest rule that fits, else null.

    A rule fits its host and all subdomains of it, if the path starts with the rule's.
    """
    fits = lambda r: ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
    return F.coalesce(*[F.when(fits(r), F.lit(r.name)) for r in _order(rules)], F.lit(None).cast("string"))


def verdict_column(rule: Column, rules=RULES) -> Column:
    return F.coalesce(*[F.when(rule == r.name, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string"))


_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def url_node(url: Column) -> Column:
    """The URL as a node: scheme and host in lower case, an empty path as /, without dot segments and
    without the fragment, which servers never see. Other strings lose the fragment only."""
    part = lambda n: F.regexp_extract(url, _PARTS, n)
    whole = F.concat(F.translate(part(1), _UPPER, _LOWER), F.lit("://"), F.translate(part(2), _UPPER, _LOWER), _without_dots(part(3)), part(4))
    return F.when(F.regexp_like(url, F.lit(_PARTS)), whole).otherwise(F.regexp_extract(url, r"^([^#]*)", 1))


def _without_dots(path: Column) -> Column:
    """A path from the root without . and .. segments."""
    steps = F.split(F.regexp_replace(path, "^/", ""), "/", -1)

    def step(acc: Column, x: Column) -> Column:
        up = F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))
        return F.when(x == "..", up).when(x == ".", acc).otherwise(F.array_append(acc, x))

    folded = F.aggregate(steps, F.array().cast("array<string>"), step)
    ends = F.when(F.regexp_like(path, F.lit(r"/\.\.?$")), F.array_append(folded, F.lit(""))).otherwise(folded)
    return F.concat(F.lit("/"), F.array_join(F.when(F.regexp_like(path, F.lit(r"(^|/)\.\.?(/|$)")), ends).otherwise(steps), "/"))


def resolve(base: Column, link: Column) -> Column:
    """The URL that a link of a page leads to, null where it names no host. &amp; is decoded."""
    to = F.trim(F.regexp_replace(link, "(?i)&amp;", "&"))
    scheme, host, path = (F.regexp_extract(base, _PARTS, n) for n in (1, 2, 3))
    root = F.concat(scheme, F.lit("://"), host)
    known = F.regexp_like(base, F.lit(_PARTS))
    found = (
        F.when(F.contains(to, F.lit("://")) & F.regexp_like(to, F.lit(_PARTS)), to)
        .when(F.regexp_like(to, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")) | ~known, F.lit(None).cast("string"))
        .when(F.startswith(to, F.lit("//")), F.concat(scheme, F.lit(":"), to))
        .when(F.startswith(to, F.lit("/")), F.concat(root, to))
        .when(F.startswith(to, F.lit("?")), F.concat(root, path, to))
        .when((to == "") | F.startswith(to, F.lit("#")), F.lit(None).cast("string"))
        .otherwise(F.concat(root, F.regexp_replace(F.when(path == "", F.lit("/")).otherwise(path), "[^/]*$", ""), to))
    )
    return url_node(found)


def alias_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): canonical links and refresh redirects found in whole pages, resolved against the page's URL."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    links = F.regexp_extract_all(html, F.lit(r"(?i)(<link\b[^>]*>)"), F.lit(1))
    links = F.filter(links, lambda x: F.regexp_like(x, F.lit(r"(?i)\brel\s*=\s*[\"']?canonical\b")))
    canonical = F.transform(links, lambda x: F.regexp_extract(x, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    metas = F.regexp_extract_all(html, F.lit(r"(?i)(<meta\b[^>]*>)"), F.lit(1))
    metas = F.filter(metas, lambda x: F.regexp_like(x, F.lit(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")))
    refresh = F.transform(metas, lambda x: F.regexp_extract(x, r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    found = pages.where(F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("http-equiv")))
    found = found.select(F.col(url_col).alias("_url"), F.explode(F.concat(canonical, refresh)).alias("_to"))
    return found.select(url_node(F.col("_url")).alias("a"), resolve(F.col("_url"), F.col("_to")).alias("b")).where("a is not null and b is not null")


def judge(pages: DataFrame, edges: DataFrame | None = None, rules=RULES, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages with host, path, rule and verdict (instead of any columns of these names).

    edges, if given, are further redirects (a, b) beside those in the pages. Null urls and urls
    without :// have an empty host and path, and no rule; a null url has no aliases. Rows with equal
    urls are judged alike, and the links of all of them count. Pages are read whole, however long;
    an empty table gives an empty result.
    """
    new = ["host", "path", "rule", "verdict"]
    carry = [c for c in pages.columns if c not in new]
    url = F.col("_url")
    row = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("_row")
    base = pages.select(row, F.col(url_col).alias("_url"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    base = base.withColumn("rule", rule_column(F.col("host"), F.col("path"), rules)).withColumn("_at", url_node(url))
    links = alias_edges(pages, url_col, html_col)
    if edges is not None:
        links = links.union(edges.select(url_node(F.col("a")), url_node(F.col("b"))))
    parts = components(links)
    own = verdict_column(rule_column(host_of(F.col("node")), path_of(F.col("node")), rules), rules)
    decided = parts.groupBy("component").agg(F.min(own).alias("_alias"))  # allow sorts before block
    alias = settle(parts.join(decided, "component").where(F.col("_alias").isNotNull()).select(F.col("node").alias("_node"), "_alias"))
    joined = base.join(alias, F.col("_at") == F.col("_node"), "left")
    verdict = F.coalesce(verdict_column(F.col("rule"), rules), "_alias", F.lit("allow")).alias("verdict")
    return joined.select(*[F.col("_row")[c].alias(c) for c in carry], "host", "path", "rule", verdict)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    return judge(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


ORACLE_OP7 = r"""
WITH RECURSIVE rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (
  SELECT page_id, url, html, row_number() OVER () AS n,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
e0 AS (
  SELECT regexp_extract(url, '^([^#]*)', 1) AS a, regexp_extract(b, '^([^#]*)', 1) AS b FROM (
    SELECT url, unnest(list_transform(list_filter(regexp_extract_all(html, '(?i)<link\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\brel\s*=\s*["'']?canonical\b')), lambda x: regexp_extract(x, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1))
      || list_transform(list_filter(regexp_extract_all(html, '(?i)<meta\b[^>]*>'), lambda x: regexp_matches(x, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b')), lambda x: regexp_extract(x, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1))) AS b
    FROM pages) WHERE strpos(b, '://') > 0 AND url IS NOT NULL),
e AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
nodes AS (
  SELECT a, b, CASE WHEN strpos(b, '://') > 0 THEN translate(regexp_extract(substr(b, strpos(b, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(b, '://') > 0 THEN regexp_extract(substr(b, strpos(b, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM reach),
own AS (
  SELECT a, b, (SELECT arg_max(r.verdict, length(r.host || r.path)) FROM rules r WHERE (nodes.host = r.host OR ends_with(nodes.host, '.' || r.host)) AND starts_with(nodes.path, r.path)) AS v FROM nodes),
alias AS (SELECT a, min(v) AS v FROM own GROUP BY a),
hit AS (
  SELECT p.n, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS v
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.n)
SELECT page_id, host, path, hit.rule, coalesce(hit.v, alias.v, 'allow') AS verdict
FROM p LEFT JOIN hit ON hit.n = p.n LEFT JOIN alias ON alias.a = regexp_extract(p.url, '^([^#]*)', 1)
"""
