"""URL filters whose block decisions reach every alias of a page, with DataFrame operations only.

Two addresses are equivalent if they differ in scheme, fragment or tracking
parameters only, or if one names the other in a canonical link or a redirect
(meta refresh). Connected components over those edges give the classes of
aliases; a page that no rule judges is blocked if a member of its class is
blocked by a rule and no member is allowed by one.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components

#: The rules of the op10 contract as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

_TAG_LINK = r"(?i)<link\b[^>]*>"
_TAG_META = r"(?i)<meta\b[^>]*>"
_CANONICAL = r"(?i)\brel\s*=\s*[\"']?canonical\b"
_HREF = r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
_REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
_TARGET = r"(?i)\burl\s*=\s*[\"']?([^\"'\s>;]+)"


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _rest(url: Column) -> Column:
    """What follows the first "://"; null if there is none."""
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The url without scheme, fragment and utm_ parameters, its host in lower case."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.startswith("utm_")), "&")
    return F.concat(host(url), path(url), F.when(F.coalesce(kept, F.lit("")) != "", F.concat(F.lit("?"), kept)).otherwise(""))


def _resolve(link: Column, url: Column) -> Column:
    """An absolute url for a link found on a page."""
    root = F.concat(F.lit("http://"), host(url))
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, F.regexp_extract(path(url), r"^(.*/)", 1), link))
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """Edges (a, b) between the address of a page and those it names as canonical or redirects to."""

    def named(tag: str, is_kind: str, value: str) -> Column:
        tags = F.filter(F.regexp_extract_all("html", F.lit(tag), F.lit(0)), lambda t: t.rlike(is_kind))
        return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, value, 1)), lambda x: x != "")

    may_name = F.col("html").rlike("(?i)canonical|refresh")
    links = F.concat(named(_TAG_LINK, _CANONICAL, _HREF), named(_TAG_META, _REFRESH, _TARGET))
    return (
        pages.where(F.col("url").contains("://") & may_name)
        .select("url", F.explode(links).alias("link"))
        .select(address(F.col("url")).alias("a"), address(_resolve(F.col("link"), F.col("url"))).alias("b"))
        .where("a <> b")
    )


def judge(at: Column, way: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; both null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, of, start in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((at == of) | at.endswith(f".{of}")) & way.startswith(start)
        rule, verdict = F.when(fits, of + start).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule, verdict and component (the class's least address) to every page.

    pages needs url and html. rules is a short list of (verdict, host, path): it
    becomes one expression. A null url, or one without "://", has an empty host
    and path, no rule, a null component and the verdict allow. A null html names
    no alias. Repeated rows stay; input columns with the names added are replaced.
    """
    added = ("host", "path", "rule", "verdict", "component")
    kept = [c for c in pages.columns if c not in added]
    edges = alias_edges(pages)
    member = components(edges)

    at, way = host(F.col("node_url")), path(F.col("node_url"))
    ruled = member.withColumn("node_url", F.concat(F.lit("http://"), "node"))
    ruled = ruled.withColumn("by_rule", judge(at, way, rules)[1])
    classes = ruled.groupBy("component").agg(
        F.max(F.col("by_rule") == "block").alias("any_block"), F.max(F.col("by_rule") == "allow").alias("any_allow")
    )
    aliases = member.join(classes.repartition("any_block", "component"), "component").select("node", "component", "any_block", "any_allow")

    rule, by_rule = judge(F.col("host"), F.col("path"), rules)
    spread = F.when(F.col("any_block") & ~F.coalesce("any_allow", F.lit(False)), "block").otherwise("allow")
    return (
        pages.select(*kept)
        .withColumns({"host": host(F.col("url")), "path": path(F.col("url")), "node": F.when(F.col("url").contains("://"), address(F.col("url")))})
        .join(aliases.withColumnRenamed("component", "found"), "node", "left")
        .withColumns({"rule": rule, "verdict": F.coalesce(by_rule, spread), "component": F.coalesce("found", "node")})
        .select(*kept, *added)
    )
