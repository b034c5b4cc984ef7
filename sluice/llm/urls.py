"""URL filters with redirect equivalence.

A rule decides the pages of its host and subdomains below its path; the longest rule that
fits wins. Pages that no rule decides take part in redirect classes: connected components
over canonical links and refresh redirects found in the pages. A class with an explicitly
allowed member is allowed, else one with a blocked member is blocked, else it is allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import keep, whole
from sluice.llm.components import connected_components

# Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)(\??[^#]*)"


def host_of(url: Column) -> Column:
    """Host in lower case; empty for a null url or one without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1)
    return F.translate(host, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def node_of(url: Column) -> Column:
    """What names a page in the graph: host, path and query, without scheme and fragment."""
    return F.concat(host_of(url), path_of(url), F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 3))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(verdict, rule) of the longest rule that fits, null where none does."""
    chosen = F.lit(None).cast("struct<verdict:string,rule:string>")
    # Built from the shortest up, so that the longest is tested first.
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        chosen = F.when(
            fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))
        ).otherwise(chosen)
    return chosen


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute without its quotes; empty if missing."""
    value = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", 1)
    return F.btrim(value, F.lit("\"'"))


def _absolute(link: Column, url: Column) -> Column:
    """A link as an absolute url, seen from the page at ``url``."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    origin = F.concat(scheme, F.lit("://"), host_of(url))
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, link))
        .otherwise(F.concat(origin, folder, link))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a``, ``b`` (nodes) and ``target`` (url) of every canonical link and refresh redirect."""
    tags = F.regexp_extract_all(F.coalesce(F.col(f"`{html}`"), F.lit("")), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    rows = pages.where(F.col(f"`{url}`").contains("://")).select(
        F.col(f"`{url}`").alias("url"), F.explode(tags).alias("tag")
    )
    names = ("rel", "href", "http-equiv", "content")
    rows = rows.select(
        "url",
        F.col("tag").rlike("(?i)^<link").alias("is_link"),
        *[_attribute(F.col("tag"), n).alias(n.replace("-", "_")) for n in names],
    )
    canonical = F.when(F.col("is_link") & F.col("rel").rlike(r"(?i)\bcanonical\b"), F.col("href"))
    refresh = F.when(
        ~F.col("is_link") & F.col("http_equiv").rlike(r"(?i)^\s*refresh\s*$"),
        F.regexp_extract("content", r"""(?is)url\s*=\s*['"]?([^'"]+)""", 1),
    )
    link = F.replace(F.trim(F.coalesce(canonical, refresh)), F.lit("&amp;"), F.lit("&"))
    rows = rows.select("url", link.alias("link")).where(F.col("link") != "")
    rows = rows.select("url", _absolute(F.col("link"), F.col("url")).alias("target"))
    return rows.select(node_of(F.col("url")).alias("a"), node_of(F.col("target")).alias("b"), "target").where(
        F.col("a") != F.col("b")
    )


def judge_urls(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
) -> DataFrame:
    """``row``, ``host``, ``path``, ``rule`` and ``verdict`` of every page.

    ``row`` has the input columns but the html. ``rules`` is a short list. Pages that share
    a url share a node. A null url, or one without ``://``, has an empty host and path, fits
    no rule and is allowed; a null html has no links. Link targets that are no pages count
    as members, so a rule reaches pages through them.
    """
    edges = keep(alias_edges(pages, url, html), "url-edges")
    parts = keep(connected_components(edges.select("a", "b")), "url-components")
    ends = edges.select(F.col("a").alias("node"), F.lit(None).cast("string").alias("target")).union(
        edges.select(F.col("b").alias("node"), "target")
    )
    slim = pages.drop(html)
    rest = F.struct(*[F.col(f"`{c}`") for c in slim.columns]).alias("row")
    u = F.col(f"`{url}`")
    judged = pages.select(rest, u.alias("_u"), host_of(u).alias("host"), path_of(u).alias("path"))
    judged = judged.select(
        "row",
        "host",
        "path",
        node_of(F.col("_u")).alias("_node"),
        fitting_rule(F.col("host"), F.col("path"), rules).alias("_fit"),
    )
    # A node is host and path before the query: its own rule follows from its name alone.
    full = F.concat(F.lit("x://"), F.col("node"))
    members = ends.select("node").distinct().select(
        "node", fitting_rule(host_of(full), path_of(full), rules)["verdict"].alias("v")
    )
    classes = (
        members.join(parts, "node")
        .groupBy("component")
        .agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    )
    verdicts = parts.join(classes, "component").select(
        F.col("node").alias("_member"),
        (F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))).alias("_out"),
    )
    verdicts = keep(verdicts, "url-verdicts")
    out = judged.join(verdicts, F.col("_node") == F.col("_member"), "left")
    method = F.when(F.coalesce("_out", F.lit(False)), "block").otherwise("allow")
    return out.select(
        "row",
        "host",
        "path",
        F.col("_fit.rule").alias("rule"),
        F.coalesce(F.col("_fit.verdict"), method).alias("verdict"),
    )
