"""URL filters with redirect equivalence.

Rules name a host and a path prefix; the longest fitting rule decides, so an allow inside a block and a block inside
an allow both hold. Pages link to aliases by canonical links and by meta refreshes in their HTML, and by any further
redirect table. Connected components over these edges tie aliases together: a page without a rule of its own is
blocked if any address of its component is blocked by rule, and allowed otherwise. An explicit allow takes
precedence for its own address and does not shield its aliases.

Targets are resolved against the page: with a scheme as they are, from "//" with the page's scheme, from "/" with its
host, others below its last slash ("." and ".." steps are kept as written). Addresses are the same if they are once
scheme and host are in lower case and the fragment is gone.

Components are found by distributed star contraction; rules are a parameter and become one column expression.

Of several canonical links or refreshes on a page each counts. Defined results: null URLs and URLs without "://" have empty host and path, fit no rule and have no aliases; rows with
equal URLs are aliases; empty tables and columns with any other names are fine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparrowlake.llm.common import written
from sparrowlake.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """``host`` and its subdomains, below ``path`` (which begins with a slash)."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest fitting rule as (name, verdict); null if none fits."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.struct(F.lit(rule.name).alias("rule"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def address(url: Column) -> Column:
    """What tells addresses apart: scheme and host in lower case, no fragment; null without "://"."""
    head = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(F.translate(head, UPPER, LOWER), rest))


def resolved(page: Column, target: Column) -> Column:
    """The address that ``target`` names on ``page``; null for fragments, other schemes (mailto:) and pages without "://"."""
    scheme = F.regexp_extract(page, r"(?s)^(.*?:)//", 1)
    host = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(page, r"(?s)^(.*?://[^?#]*)", 1)
    folder = F.when(path == host, F.concat(host, F.lit("/"))).otherwise(F.regexp_extract(path, r"(?s)^(.*/)", 1))
    full = (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(F.startswith(target, F.lit("//")), F.concat(scheme, target))
        .when(F.startswith(target, F.lit("/")), F.concat(host, target))
        .when(F.startswith(target, F.lit("?")), F.concat(path, target))
        .when((target != "") & ~F.startswith(target, F.lit("#")) & ~target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(folder, target))
    )
    return F.when(F.contains(page, F.lit("://")), address(full))


def html_aliases(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(url, target): addresses of pages and of what their canonical links and meta refreshes name."""
    tags = lambda kind, mark: F.filter(F.regexp_extract_all(html_col, F.lit(rf"(?is)(<{kind}\b[^>]*>)"), F.lit(1)), lambda t: t.rlike(mark))
    value = lambda t, name: F.regexp_replace(F.regexp_extract(t, rf"(?is)\b{name}\s*=\s*[\"']?\s*([^\"'\s>]+)", 1), "&amp;", "&")
    canonical = F.transform(tags("link", r"(?is)\brel\s*=\s*([\"'][^\"'>]*\bcanonical\b|canonical\b)"), lambda t: value(t, "href"))
    refresh = F.transform(tags("meta", r"(?is)\bhttp-equiv\s*=\s*[\"']?\s*refresh\b"), lambda t: value(t, "url"))
    found = pages.select(F.col(url_col).alias("page"), F.explode(F.concat(canonical, refresh)).alias("target"))
    return found.select(address(F.col("page")).alias("url"), resolved(F.col("page"), F.col("target")).alias("target")).where("url is not null and target is not null")


def filter_urls(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    redirects: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """One row for each page: id, host, path, rule, verdict. ``redirects``: (url, target)."""
    edges = html_aliases(pages, url_col, html_col)
    if redirects is not None:
        more = redirects.select(address(F.col("url")).alias("url"), resolved(F.col("url"), F.col("target")).alias("target"))
        edges = edges.unionByName(more.where("url is not null and target is not null"))
    edges = written(edges.distinct(), "url-edges")
    host, path = host_and_path(F.col("url"))
    judged = lambda df: df.withColumn("own", matched_rule(*host_and_path(F.col("url")), rules))
    rows = judged(pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"))).select("page", address(F.col("url")).alias("url"), host.alias("host"), path.alias("path"), "own")
    parts = connected_components(edges.select(F.col("url").alias("u"), F.col("target").alias("v")), "url-parts")
    # addresses that only other pages name count as well
    blocked = judged(parts.withColumnRenamed("node", "url")).where("own.verdict = 'block'").select("component").distinct()
    tainted = parts.join(blocked, "component").select(F.col("node").alias("url"), F.lit("block").alias("alias_verdict"))
    out = rows.join(tainted, "url", "left")
    return out.select(F.col("page").alias(id_col), "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "alias_verdict", F.lit("allow")).alias("verdict"))
