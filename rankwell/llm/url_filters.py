"""URL filters with redirect equivalence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankwell.llm.common import lower_ascii, text_or_empty
from rankwell.llm.components import connected_components
from rankwell.operators.skew import lookup_join
from rankwell.sources.scratch import materialize

# Verdict, host and path of every rule.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_CANONICAL = r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>"
_REFRESH = r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>"
_HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_TARGET = r"(?is)\burl\s*=\s*['\"]?([^\"'\s>]+)"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return lower_ascii(F.regexp_extract(text_or_empty(url), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(text_or_empty(url), "://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule (as host and path written together) that fits, as a struct of rule and verdict; else null.

    A rule fits its host and every subdomain of it where the path starts with the rule's. Of two rules of equal length an
    allow goes first. Rules are part of the expression: they are a list that a person writes, not a table.
    """
    longest_first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow"))
    listed = F.array(
        *(
            F.struct(*(F.lit(x).alias(name) for name, x in zip(("verdict", "host", "path", "rule"), (*r, r[1] + r[2]), strict=True)))
            for r in longest_first
        )
    )

    def fits(rule: Column) -> Column:
        in_host = (host == rule["host"]) | host.endswith(F.concat(F.lit("."), rule["host"]))
        return in_host & path.startswith(rule["path"])

    return F.get(F.filter(listed, fits), F.lit(0))


def _with_parts(rows: DataFrame, url: str = "url") -> DataFrame:
    """``rows`` with the URL's host, path and rest (path and query), each worked out once."""
    rows = rows.withColumns(
        {
            "host": F.regexp_extract(text_or_empty(F.col(url)), "://([^/?#]*)", 1),
            "path": path_of(F.col(url)),
            "rest": F.regexp_extract(text_or_empty(F.col(url)), "://[^/?#]*([^#]*)", 1),
        }
    )
    return rows.withColumn("host", lower_ascii(F.col("host")))


def _alias_key() -> Column:
    """What a URL is known by among aliases: host, path and query, without scheme and fragment; null where no host."""
    return F.when(F.col("host") != "", F.concat("host", F.when(F.col("rest") == "", "/").otherwise(F.col("rest"))))


def _absolute() -> Column:
    """A link as seen from the page: whole, ``//host/..``, ``/path`` or relative to the folder of the page."""
    target, site = F.col("target"), F.concat(F.lit("http://"), "host")
    folder = F.regexp_extract("path", "^(.*/)", 1)
    return (
        F.when(target.contains("://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(site, target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target))
    )


def page_links(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(source, target) keys of every canonical link and every refresh redirect in the pages' HTML."""
    url, html = pages[url_col], text_or_empty(pages[html_col])
    canonical = F.transform(
        F.regexp_extract_all(html, F.lit(_CANONICAL), F.lit(0)), lambda tag: F.regexp_extract(tag, _HREF, 1)
    )
    refresh = F.transform(
        F.regexp_extract_all(html, F.lit(_REFRESH), F.lit(0)), lambda tag: F.regexp_extract(tag, _TARGET, 1)
    )
    found = pages.select(url.alias("url"), F.explode(F.concat(canonical, refresh)).alias("target"))
    found = found.filter("target <> ''")
    found = _with_parts(found).select(_alias_key().alias("source"), _absolute().alias("link"))
    return _with_parts(found, "link").select("source", _alias_key().alias("target"))


def filter_urls(
    pages: DataFrame,
    *,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str | None = "html",
) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for every row of ``pages``.

    A URL that a rule fits has that rule's verdict. Any other takes the verdict of its aliases: the connected component
    over canonical links, refresh redirects and the rows of ``redirects`` (source URL, target URL; its first two
    columns). A component with a page that a rule allows is allowed, else one with a page that a rule blocks is
    blocked; what is left is allowed. A null URL or one without ``://`` has an empty host and path, and no aliases.
    Links to pages that are not in the table still join the pages that name them, and a rule that fits such a link
    counts as well. Repeated rows give repeated rows.
    """
    url = pages[url_col]
    judged = _with_parts(pages.select(pages[id_col].alias("page_id"), url.alias("url")))
    judged = judged.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)).withColumn("key", _alias_key())
    links = []
    if html_col:
        links.append(page_links(pages, url_col=url_col, html_col=html_col))
    if redirects is not None:
        source, target = redirects.columns[:2]
        known = redirects.select(redirects[source].alias("from"), redirects[target].alias("to"))
        known = _with_parts(known, "from").select(_alias_key().alias("source"), "to")
        links.append(_with_parts(known, "to").select("source", _alias_key().alias("target")))
    decided = _component_verdicts(links, rules) if links else None
    shown = judged.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.col("own.verdict").alias("verdict"), "key")
    if decided is None:
        return shown.drop("key").withColumn("verdict", F.coalesce("verdict", F.lit("allow")))
    joined = lookup_join(shown.withColumn("spread", F.xxhash64("page_id")), decided, "key", "spread", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("verdict", "passed_on", F.lit("allow")).alias("verdict"))


def _component_verdicts(links: list[DataFrame], rules: Sequence[tuple[str, str, str]]) -> DataFrame | None:
    """(key, passed_on): the verdict of the component of every linked URL."""
    edges = links[0]
    for more in links[1:]:
        edges = edges.unionByName(more)
    edges = materialize(edges.dropna().filter("source <> target").distinct(), "url-links")
    if edges.isEmpty():
        return None
    keys = edges.select(F.explode(F.array("source", "target")).alias("key")).distinct()
    numbered = materialize(keys.withColumn("node", F.monotonically_increasing_id()), "url-nodes")
    a = numbered.select(F.col("key").alias("source"), F.col("node").alias("a"))
    b = numbered.select(F.col("key").alias("target"), F.col("node").alias("b"))
    components = connected_components(edges.join(a, "source").join(b, "target").select("a", "b"))
    located = _with_parts(numbered.withColumn("url", F.concat(F.lit("http://"), "key")))
    ruled = located.withColumn("own", rule_of(F.col("host"), F.col("path"), rules)["verdict"]).select("key", "node", "own")
    members = materialize(ruled.join(components, "node"), "url-components")
    verdicts = members.groupBy("component").agg(F.min("own").alias("passed_on"))  # allow sorts before block
    return lookup_join(members, verdicts, "component", "node").select("key", "passed_on")


def query(pages: DataFrame) -> DataFrame:
    return filter_urls(pages)


def query_with_redirects(pages: DataFrame) -> DataFrame:
    """Every page taken to redirect to the page whose number is the ten below it: components of up to ten pages."""
    first = F.col("page_id") - F.col("page_id") % 10
    sources = pages.select(F.col("url").alias("source"), first.alias("first"))
    targets = pages.select(F.col("page_id").alias("first"), F.col("url").alias("target"))
    return filter_urls(pages, redirects=sources.join(targets, "first").select("source", "target"))


# Every page to the first of its ten, by the keys that pages go by.
_TENS = "SELECT s.key, 'x://' || t.key AS target FROM k s JOIN k t ON t.page_id = s.page_id - s.page_id % 10 WHERE t.key IS NOT NULL"


def _sql(rules: Sequence[tuple[str, str, str]] = RULES, redirects: str | None = None) -> str:
    listed = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in rules)
    return f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {listed}),
p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
        translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(coalesce(url, ''), '://[^/?#]*([^#]*)', 1) AS rest FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN rest = '' THEN '/' ELSE rest END END AS key FROM p),
found AS (SELECT key, regexp_extract(tag, '(?is)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1) AS target FROM
            (SELECT key, unnest(regexp_extract_all(html, '(?is)<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>')) AS tag FROM k)
          UNION ALL
          SELECT key, regexp_extract(tag, '(?is)\\burl\\s*=\\s*[''"]?([^"''\\s>]+)', 1) FROM
            (SELECT key, unnest(regexp_extract_all(html, '(?is)<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>')) AS tag FROM k)
          {"UNION ALL " + redirects if redirects else ""}),
edges AS (SELECT key AS a, regexp_extract(target, '://(.*)$', 1) AS b FROM found WHERE target LIKE '%://%' AND key IS NOT NULL),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reached(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reached r JOIN both_ways e ON r.b = e.a),
fits AS (SELECT k.page_id, k.url, k.key, r.host || r.path AS rule, r.verdict,
           row_number() OVER (PARTITION BY k.page_id ORDER BY length(r.host || r.path) DESC) AS nth
         FROM k JOIN rules r ON (k.host = r.host OR k.host LIKE '%.' || r.host) AND starts_with(k.path, r.path)),
passed AS (SELECT r.a AS key, min(f.verdict) AS verdict FROM reached r JOIN fits f ON f.key = r.b AND f.nth = 1 GROUP BY r.a)
SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.verdict, passed.verdict, 'allow') AS verdict
FROM k LEFT JOIN fits f ON f.page_id = k.page_id AND f.nth = 1 LEFT JOIN passed ON passed.key = k.key
"""


SQL = _sql()
SQL_WITH_REDIRECTS = _sql(redirects=_TENS)
