"""URL filters: block and allow rules, carried over to aliases by redirect equivalence.

A rule (action, host, path) fits a URL whose host is the rule's or a subdomain of it and whose path starts with the
rule's; the longest fitting rule wins. URLs joined by a redirect (``http-equiv=refresh``, or a row of a given redirect
table) or by a canonical link stand for the same page: their connected components are found with distributed joins, and
a URL that no rule fits takes over a decision of its component, allow before block. With neither it is allowed.

Targets are resolved against the page's URL, or its ``<base href>`` where that is a whole URL: without scheme, from the root,
or relative to its folder, dots included. Null URLs, and URLs without ``://``, have empty host and path, fit no rule, link with
nothing and are allowed. Pages without HTML have no links. Repeated rows give repeated results; of rules of one length the later
in the list wins; columns host, path, rule, verdict and component of the input are replaced. An empty table gives an empty
result; a link to oneself is no edge. Rules are configuration: a Python list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import lowered
from .components import components

RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host(url: Column) -> Column:
    return F.coalesce(lowered(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """What names a page: the URL without its fragment, scheme and host in lower case; null where there is no ``://``."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    head = F.regexp_extract(bare, r"(?s)^(.*?://[^/?#]*)", 1)
    return F.when(F.coalesce(bare.contains("://"), F.lit(False)), F.concat(lowered(head), F.substr(bare, F.char_length(head) + 1)))


def judged(h: Column, p: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action; null for none."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rh, rp in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((h == rh) | h.endswith("." + rh)) & p.startswith(rp)
        rule, action = F.when(fits, rh + rp).otherwise(rule), F.when(fits, act).otherwise(action)
    return rule, action


def resolved(base: Column, to: Column) -> Column:
    """The URL that a link's target names on a page of URL base; null for other schemes and bare fragments."""
    bare = F.regexp_replace(base, r"(?s)[?#].*$", "")
    head, own = F.regexp_extract(bare, r"(?s)^(.*?://[^/]*)", 1), F.regexp_extract(bare, r"(?s)^.*?://[^/]*(.*)$", 1)
    query = F.regexp_extract(to, r"(?s)(\?[^#]*)", 1)
    path = F.regexp_replace(to, r"(?s)[?#].*$", "")
    folder = F.when(F.contains(own, F.lit("/")), F.regexp_replace(own, r"[^/]*$", "")).otherwise("/")
    parts = F.split(F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(folder, path)), "/", -1)
    last = F.element_at(parts, -1)
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc).when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(acc)).otherwise(F.concat(acc, F.array(x))))
    full = F.concat(head, F.array_join(walked, "/"), F.when(last.isin(".", ".."), "/").otherwise(""), query)
    return (
        F.when(F.contains(to, F.lit("://")), to)
        .when(F.startswith(to, F.lit("//")), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), to))
        .when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (to == "") | F.startswith(to, F.lit("#")), F.lit(None).cast("string"))
        .when(F.startswith(to, F.lit("?")), F.concat(bare, query))
        .otherwise(full)
    )


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (u, v) between page names, from canonical links and refresh redirects of whole pages."""
    tags = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), F.lit(0))
    value = lambda t, name: F.coalesce(F.nullif(F.regexp_extract(t, rf"""(?is)\b{name}\s*=\s*"([^"]*)\"""", 1), F.lit("")), F.nullif(F.regexp_extract(t, rf"""(?is)\b{name}\s*=\s*'([^']*)'""", 1), F.lit("")), F.regexp_extract(t, rf"""(?is)\b{name}\s*=\s*([^"'\s>]+)""", 1))
    plain = lambda x: F.replace(F.trim(x), F.lit("&amp;"), F.lit("&"))
    canonical = F.transform(F.filter(tags, lambda t: t.rlike("(?i)^<link") & value(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")), lambda t: plain(value(t, "href")))
    refresh = F.transform(F.filter(tags, lambda t: t.rlike("(?i)^<meta") & value(t, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")), lambda t: plain(F.regexp_extract(value(t, "content"), r"""(?is)\burl\s*=\s*["']?([^"'\s]+)""", 1)))
    base = F.get(F.filter(F.transform(F.filter(tags, lambda t: t.rlike("(?i)^<base")), lambda t: plain(value(t, "href"))), lambda x: F.contains(x, F.lit("://"))), F.lit(0))
    marked = pages.filter(F.col(html).rlike(r"""(?is)<(?:link|meta)\b[^>]*(?:canonical|refresh)""")).filter(F.contains(F.col(url), F.lit("://")))
    raw = marked.select(F.col(url).alias("url"), F.coalesce(base, F.col(url)).alias("base"), F.explode(F.array_distinct(F.concat(canonical, refresh))).alias("to"))
    return raw.select(node(F.col("url")).alias("u"), node(resolved(F.col("base"), F.col("to"))).alias("v")).filter("u is not null and v is not null and u != v")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """pages with host, path, rule (null for none), verdict and component (null for a page without aliases).

    redirects: optional table (from_url, to_url) beside the links found in the pages."""
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.union(redirects.select(node(F.col("from_url")), node(F.col("to_url"))))
    found = components(edges)
    action = judged(host(F.col("node")), path(F.col("node")), rules)[1]
    decided = found.withColumn("action", action).groupBy("component").agg(F.when(F.max(F.col("action") == "allow"), "allow").when(F.max(F.col("action") == "block"), "block").otherwise("allow").alias("taken"))
    member = found.join(decided, "component").select(F.col("node").alias("_node"), F.col("component").alias("_component"), F.col("taken").alias("_taken"))
    rule, action = judged(F.col("_host"), F.col("_path"), rules)
    own = pages.withColumns({"_host": host(F.col(url)), "_path": path(F.col(url)), "_name": node(F.col(url))}).withColumns({"_rule": rule, "_action": action})
    # Pages without a name have keys of their own, which no name equals, so that they do not meet in one task.
    own = own.withColumn("_name", F.coalesce("_name", F.concat(F.lit("?"), F.monotonically_increasing_id().cast("string"))))
    out = own.join(member, F.col("_name") == F.col("_node"), "left")
    clash = [c for c in ("host", "path", "rule", "verdict", "component") if c in pages.columns]
    return out.drop(*clash).withColumns({"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule"), "verdict": F.coalesce("_action", "_taken", F.lit("allow")), "component": F.col("_component")}).drop("_host", "_path", "_name", "_rule", "_action", "_node", "_component", "_taken")
