"""URL filters in Spark expressions, with decisions that follow redirects.

A rule names a host and a path prefix, fits the host and its subdomains, and the
longest fitting rule decides; of equally long ones an allow. Pages that no rule
fits take the decision of their redirect class: canonical links and meta
refreshes are edges between URLs, connected components of those edges are the
classes, and a class with a blocked URL blocks its other members. A page's own
allow rule stands whatever its class holds.

A URL's node is its host, path and query: scheme and fragment do not count.
Link targets may be absolute, ``//host/...`` or ``/path``; others are no edges.

Defined cases: a null URL or one without ``://`` has an empty host and path, no
rule and no class, and is allowed; null html has no links; a null page_id keeps
its row; repeated rows get equal results; an empty table gives an empty result;
other columns are not read; a very long page is gone through by patterns without
nested repeats.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written
from .graph import components

#: Up to so many rules are written into the expression; more are joined by host.
INLINE_RULES = 256

#: Fixed values: (verdict, host, path prefix).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*?\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*?\bcontent\s*=\s*["']?(?:(?<=")[^">]*?|(?<=')[^'>]*?|(?<!["'])[^"'>]*?)url\s*=\s*["']?([^"'\s>]+)"""


def lower_ascii(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def rest_of(url: Column) -> Column:
    """What follows the first ``://``, or null."""
    at = F.call_function("instr", url, F.lit("://"))
    return F.when(at > 0, F.substr(url, at + 3, F.length(url)))


def host_of(rest: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(rest: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(rest: Column) -> Column:
    """Host, path and query of a URL; null without a host."""
    node = F.concat(host_of(rest), F.regexp_extract(rest, r"^[^/?#]*([^#]*)", 1))
    return F.when(F.length(host_of(rest)) > 0, node)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as ``struct<size,allow,rule,verdict>``, or null."""
    fits = []
    for verdict, rule_host, prefix in rules:
        fit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        rule = rule_host + prefix
        fits.append(F.when(fit, F.struct(F.lit(len(rule)).alias("size"), F.lit(verdict == "allow").alias("allow"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,allow:boolean,rule:string,verdict:string>")


def joined_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls(host, path)`` -> the longest rule of each, for long rule tables.

    Every suffix of a host (a handful) meets the rules of that host by equality.
    """
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    asked = urls.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("rule_host"))
    fit = asked.join(rules.select(F.col("host").alias("rule_host"), F.col("path").alias("prefix"), "verdict"), "rule_host").where(F.col("path").startswith(F.col("prefix")))
    rule = F.concat("rule_host", "prefix")
    best = F.max(F.struct(F.length(rule).alias("size"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule"), "verdict"))
    return urls.join(fit.groupBy("host", "path").agg(best.alias("found")), ["host", "path"], "left")


def judged(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds ``found`` to ``urls(host, path, ...)``."""
    if isinstance(rules, list) and len(rules) > INLINE_RULES:
        rules = urls.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    if isinstance(rules, list):
        return urls.withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
    return joined_rules(urls, rules)


def link_edges(pages: DataFrame) -> DataFrame:
    """``(a, b)``: nodes of a page and of each of its canonical links and refresh targets."""
    rest = rest_of(F.col("url"))
    html = F.coalesce(F.col("html"), F.lit(""))
    none = F.array().cast("array<string>")
    targets = F.concat(*(F.coalesce(F.when(html.rlike(f"(?i){word}"), F.regexp_extract_all(html, F.lit(pattern), F.lit(1))), none) for word, pattern in (("canonical", CANONICAL), ("http-equiv", REFRESH))))
    held = pages.where(html.rlike("(?i)canonical|http-equiv")).select(node_of(rest).alias("a"), host_of(rest).alias("host"), F.explode(targets).alias("target"))
    target = F.replace(F.col("target"), F.lit("&amp;"), F.lit("&"))
    to = (
        F.when(F.call_function("instr", target, F.lit("://")) > 0, rest_of(target))
        .when(target.startswith("//"), F.substr(target, F.lit(3), F.length(target)))
        .when(target.startswith("/"), F.concat("host", target))
    )
    return held.where("target <> '' and a is not null").select("a", node_of(to).alias("b")).where("b is not null and a <> b")


def filtered(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES) -> DataFrame:
    """``pages(page_id, url, html)`` -> ``(page_id, host, path, rule, verdict)``."""
    spark = pages.sparkSession
    classes, paths = components(link_edges(pages), "aliases")
    places = classes.select("node", "root", F.regexp_extract("node", "^([^/?]*)", 1).alias("host"), F.regexp_extract("node", r"^[^/?]*([^?]*)", 1).alias("path"))
    blocked = judged(places, rules).groupBy("root").agg(F.bool_or(F.col("found.verdict") == "block").alias("blocked")).where("blocked")
    aliases, _ = written(classes.join(blocked, "root", "left_semi").select("node").distinct(), "blocked-aliases")
    drop(spark, *paths)
    rest = rest_of(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(rest).alias("host"), path_of(rest).alias("path"), node_of(rest).alias("node"))
    own = judged(urls, rules).join(aliases.withColumn("blocked", F.lit(True)), "node", "left")
    verdict = F.coalesce("found.verdict", F.when(F.col("blocked"), "block"), F.lit("allow"))
    return own.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL of the query, classes by reachability from blocked nodes."""
    rules = ", ".join(f"({_quoted(v)}, {_quoted(h)}, {_quoted(p)})" for v, h, p in RULES)
    canonical = r"(?is)<link\b[^>]*\brel\s*=\s*[\"'']?canonical\b[^>]*?\bhref\s*=\s*[\"'']?([^\"''\s>]+)|<link\b[^>]*?\bhref\s*=\s*[\"'']?([^\"''\s>]+)[^>]*\brel\s*=\s*[\"'']?canonical\b"
    canonical = canonical.replace('\\"', '"')
    return rf"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {rules}),
cut AS (SELECT page_id, html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
own AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail
  FROM cut),
raw AS (
  SELECT host, CASE WHEN host <> '' THEN host || tail END AS a,
    replace(regexp_extract(html, '{canonical}', 1) || regexp_extract(html, '{canonical}', 2), '&amp;', '&') AS target
  FROM own WHERE html ILIKE '%canonical%'),
linked AS (
  SELECT a, CASE WHEN position('://' IN target) > 0 THEN substr(target, position('://' IN target) + 3)
    WHEN target LIKE '//%' THEN substr(target, 3) WHEN target LIKE '/%' THEN host || target END AS b
  FROM raw WHERE a IS NOT NULL AND target <> ''),
edges AS (SELECT a, regexp_extract(b, '^([^#]*)', 1) AS b FROM linked WHERE b IS NOT NULL UNION SELECT regexp_extract(b, '^([^#]*)', 1), a FROM linked WHERE b IS NOT NULL),
nodes AS (SELECT DISTINCT a AS node, regexp_extract(a, '^([^/?]*)', 1) AS host, regexp_extract(a, '^[^/?]*([^?]*)', 1) AS path FROM edges),
bad AS (
  SELECT node, arg_max(verdict, length(h || p)) AS verdict FROM nodes JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY node),
reached(node) AS (SELECT node FROM bad WHERE verdict = 'block' UNION SELECT b FROM reached JOIN edges ON a = node),
hit AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT host, path FROM own) JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY host, path)
SELECT page_id, own.host AS host, own.path AS path, rule,
  coalesce(verdict, CASE WHEN own.host <> '' AND own.host || tail IN (SELECT node FROM reached) THEN 'block' END, 'allow') AS verdict
FROM own LEFT JOIN hit ON own.host = hit.host AND own.path = hit.path
"""
