"""Url rules, carried over redirects and canonical links to a page's aliases.

A url's own verdict is that of the longest rule that fits it. Urls that differ only in
what does not change the page (scheme, ``www.``, default port, fragment, tracking
parameters, a last slash) are one address; redirects (``meta refresh``, or a given table)
and canonical links join addresses into components, found by distributed connected
components. A url without a rule is allowed if its component holds an allowed one, else
blocked if it holds a blocked one, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components

MAX_RULES = 1000  # held in the plan; more raise an error

#: Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_TRACKING = r"(?i)(?<=^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&]*&?"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address_of(url: Column) -> Column:
    """The form that all spellings of one address share; null for what is no url."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(?:80|443)$", "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), r"&$", "")
    return F.when(F.contains(url, F.lit("://")), F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one. A rule fits its host and
    all subdomains, and every path that its path starts. Of equally long ones an allow goes first."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1] + r[2])):  # later ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _targets(html: Column, tag: str, target: str) -> Column:
    """What each of a page's tags points to; empty for a tag without a target."""
    return F.transform(F.regexp_extract_all(html, F.lit(tag), F.lit(0)), lambda t: F.regexp_extract(t, target, 1))


def page_links(pages: DataFrame) -> DataFrame:
    """``from_url, to_url`` of all of the pages' canonical links and refresh redirects. Relative targets are
    taken from the page's url."""
    url, html = F.col("url"), F.col("html")
    canonical = _targets(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)")
    refresh = _targets(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)")
    scheme = F.regexp_extract(url, r"^(.*?)://", 1)
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(path_of(url), r"(?s)^(.*/)", 1)
    links = pages.select(pages["url"].alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html")).where(
        "contains(url, '://') and (contains(lower(html), 'canonical') or contains(lower(html), 'refresh'))")
    links = links.select(url, F.explode(F.array_distinct(F.concat(canonical, refresh))).alias("to")).where("to != ''")
    to = F.col("to")
    return links.select(url.alias("from_url"), F.when(F.contains(to, F.lit("://")), to)
                        .when(to.startswith("//"), F.concat(scheme, F.lit(":"), to))
                        .when(to.startswith("/"), F.concat(root, to))
                        .otherwise(F.concat(root, F.when(folder != "", folder).otherwise("/"), to)).alias("to_url"))


def judge_pages(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict``.

    A null url, or one without ``://``, has an empty host and path, no aliases, and is allowed. Null
    and repeated page_ids and urls are rows like any other; a null html has no links; links
    that are null or no urls are ignored. A very long html is searched whole, within its row. No rows give no rows; other columns are ignored."""
    url = pages["url"]
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(host, path, rules)
    judged = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"),
                          rule.alias("rule"), verdict.alias("own"), address_of(url).alias("address"))
    links = page_links(pages)
    if redirects is not None:
        links = links.unionByName(redirects.select("from_url", "to_url"))
    alias = connected_components(links.select(address_of(F.col("from_url")).alias("u"), address_of(F.col("to_url")).alias("v")))

    # Targets of links need not be pages: a rule that fits a target judges its component too.
    targets = links.select("to_url", "from_url").select(F.explode(F.array("to_url", "from_url")).alias("url"))
    targets = targets.select(rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)[1].alias("own"), address_of(F.col("url")).alias("address"))
    said = judged.select("own", "address").unionByName(targets).where("own is not null and address is not null").groupBy("address").agg(
        F.max(F.col("own") == "allow").alias("allowed"))
    of_component = said.join(alias, said["address"] == alias["node"], "left").select(
        F.coalesce("component", "address").alias("component"), "allowed").groupBy("component").agg(F.max("allowed").alias("allowed"))
    # verdicts of addresses: those of their component, or of themselves where no link is
    of_address = (alias.join(of_component, "component").select(F.col("node").alias("address"), "allowed")
                  .unionByName(said.join(alias, said["address"] == alias["node"], "left_anti").select("address", "allowed")))
    bare = judged.where("own is null").drop("own").join(of_address, "address", "left").select(
        "page_id", "host", "path", "rule", F.when(F.coalesce("allowed", F.lit(True)), "allow").otherwise("block").alias("verdict"))
    ruled = judged.where("own is not null").select("page_id", "host", "path", "rule", F.col("own").alias("verdict"))
    return ruled.unionByName(bare)
