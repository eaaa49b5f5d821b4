"""URL filters that treat redirects and canonical links as names of one page.

Rules name a host and a path. The longest rule that fits a URL decides it. A URL without a rule of
its own takes the decision of the addresses it is connected with by redirects and canonical links:
block if one of them is blocked, unless one of them is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strideframe.llm.common import kept_table
from strideframe.llm.components import components

#: Query parameters that tell where a visitor came from, not what the page is.
TRACKING = r"(?i)(^|&)(utm_[a-z_]*|ref|fbclid|gclid)=[^&]*"


def host_of(url: Column) -> Column:
    """What stands after the first :// up to / ? # or the end, A-Z in lower case; empty without ://."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """The plain form of a URL: no scheme, fragment, tracking parameters, trailing slash or .html.

    A URL and its plain form are connected, which stands for the usual redirects between the forms.
    """
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"(?s)^[^#?]*\?([^#]*)", 1), TRACKING, ""), "^&", "")
    path = F.regexp_replace(path_of(url), r"(\.html?|/)$", "")
    return F.when(url.contains("://"), F.concat(host_of(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))).otherwise(url)


def _absolute(link: Column, page: Column) -> Column:
    root = F.regexp_extract(page, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(page, r"(?s)^(.*?:)//", 1)
    return F.when(link.contains("://"), link).when(link.startswith("//"), F.concat(scheme, link)).when(link.startswith("/"), F.concat(root, link))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): plain addresses of a page and of the targets of its canonical link and its redirect."""
    tags = lambda name: F.regexp_extract_all("html", F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0))
    canonical = F.transform(F.filter(tags("link"), lambda t: t.rlike(r"(?i)\brel\s*=\s*[\"']?canonical\b")), lambda t: F.regexp_extract(t, r"(?i)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    refresh = F.transform(F.filter(tags("meta"), lambda t: t.rlike(r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b")), lambda t: F.regexp_extract(t, r"(?i)\burl\s*=\s*([^\"'\s>;]+)", 1))
    links = pages.where("url is not null and html is not null").select("url", F.explode(F.concat(canonical, refresh)).alias("link")).where("link <> ''")
    return links.select(address(F.col("url")).alias("u"), address(_absolute(F.col("link"), F.col("url"))).alias("v")).where("u is not null and v is not null").distinct()


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """`urls` (url) with host, path, and rule and own verdict of the longest rule that fits, or null.

    Every suffix of a host is looked up, so the work does not grow with the number of rules.
    """
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = parts.select("url", "path", F.explode(suffixes).alias("rule_host"))
    fits = tried.join(rules, "rule_host").where(F.expr("startswith(path, rule_path)"))
    rule = F.concat("rule_host", "rule_path")
    best = fits.groupBy(F.col("url").alias("of")).agg(F.max(F.struct(F.length(rule).alias("n"), rule.alias("rule"), (F.col("decision") == "allow").alias("allows"))).alias("best"))
    own = F.when(F.col("best").isNotNull(), F.when(F.col("best.allows"), "allow").otherwise("block"))
    return parts.join(best, F.col("url").eqNullSafe(F.col("of")), "left").select("url", "host", "path", F.col("best.rule").alias("rule"), own.alias("own"))


def judged_pages(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    `rules` has rule_host, rule_path and decision (allow or block). A null URL or one without ://
    has an empty host and path, fits no rule and is allowed, unless its aliases are blocked. Of
    rules of equal length the later by text, then allow, wins. Repeated rows give a row each; other
    columns are ignored; empty tables give an empty result.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    ruled = kept_table(with_rule(pages.select("url").distinct(), rules).withColumn("node", address(F.col("url"))), "ruled")
    groups = kept_table(components(alias_edges(pages), "u", "v"), "groups")
    named = ruled.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    decided = (named.where("own is not null and group is not null").groupBy("group")
               .agg(F.max(F.when(F.col("own") == "allow", 1).otherwise(0)).alias("allows"), F.max(F.when(F.col("own") == "block", 1).otherwise(0)).alias("blocks")))
    judged = named.join(decided, "group", "left").select(
        F.col("url").alias("of"), "host", "path", "rule",
        F.coalesce("own", F.when((F.col("blocks") == 1) & (F.col("allows") == 0), "block"), F.lit("allow")).alias("verdict"))
    return pages.select("page_id", "url").join(judged, F.col("url").eqNullSafe(F.col("of"))).select("page_id", "host", "path", "rule", "verdict")
