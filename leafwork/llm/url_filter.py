"""URL filter with redirect equivalence: rules judge single URLs, and a block spreads over all aliases of a page.

Aliases are the connected components over redirects (a table of them, and ``<meta http-equiv=refresh>``) and canonical links
(``<link rel=canonical>``). A node is a URL's canonical spelling: scheme and fragment off, host in lower case, tracking parameters
removed, an empty path as ``/``. If a rule blocks any URL of a component, URLs of it that no rule fits are blocked; an explicit allow
rule keeps its URL open whatever its aliases are, and a URL that neither a rule nor an alias decides is allowed.

A rule is a host, a path prefix and a verdict. It fits its host and all subdomains if the URL's path starts with the prefix; the longest
fitting rule wins (host and path together), of two of one length that with the longer host, and of the very same rule given twice, allow.
Rules are a table of any size: each distinct URL is looked up under those suffixes of its host and prefixes of its path that have as
many labels or characters as some rule's (only these few numbers reach the driver), as a join, so that Spark decides by size whether
rules are broadcast.

Everything is DataFrame functions. The pages' HTML is read once; URLs, edges and components are tables of their own.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and is no node; null HTML has no links; a
relative link is resolved against the page's URL; links in comments and scripts don't count; an empty href, or one of another
scheme without ``://``, is no edge; repeated pages are judged alike and keep a row each; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwork.functions.text import let
from leafwork.llm.common import cut
from leafwork.llm.components import connected_components

#: Rules of the registered query: host, path prefix, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Query parameters that don't change what a URL shows.
TRACKING = r"utm_[a-z]+|gclid|fbclid|msclkid"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without it."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From behind the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def node_of(url: Column) -> Column:
    """The URL's canonical spelling, null for one without a host."""
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    query = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(rf"^(?i:{TRACKING})(=|$)")), "&")
    path = F.when(path_of(url) == "", "/").otherwise(path_of(url))
    return F.when(host_of(url) != "", F.concat(host_of(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _attribute(tag: Column, name: str) -> Column:
    """An attribute's value: quoted either way or bare."""
    found = [F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*{form}", 1) for form in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")]
    value = F.coalesce(*(F.nullif(f, F.lit("")) for f in found), F.lit(""))
    return F.trim(F.replace(value, F.lit("&amp;"), F.lit("&")))


def _resolve(href: Column, url: Column) -> Column:
    """A link's target as an absolute URL; null if it has none."""
    origin = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*", 0)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    joined = F.when(href.startswith("/"), href).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), href))
    parts = F.split(F.regexp_extract(joined, r"^[^?#]*", 0), "/")
    fold = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(p == ".", acc).when((p == "..") & (F.size(acc) > 1), F.slice(acc, 1, F.size(acc) - 1)).when(p == "..", acc).otherwise(F.concat(acc, F.array(p))),
    )
    ends = F.when(F.get(parts, F.size(parts) - 1).isin(".", ".."), "/").otherwise("")
    local = F.concat(origin, F.concat(F.array_join(fold, "/"), ends), F.regexp_extract(joined, r"[?#].*$", 0))
    return (
        F.when(href == "", None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(url, r"^[^:/?#]+:", 0), href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (origin == ""), None)
        .when(href.startswith("#"), url)
        .when(href.startswith("?"), F.concat(origin, path_of(url), href))
        .otherwise(local)
    )


def link_targets(url: Column, html: Column) -> Column:
    """Absolute URLs that a page names as its canonical address or sends its readers to, as an array."""
    plain = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>", " ")

    def hrefs(text: Column) -> Column:
        tags = F.regexp_extract_all(text, F.lit(r"(?is)<(?:link|meta)\s[^>]*>"), F.lit(0))
        links = F.filter(tags, lambda t: t.rlike(r"(?is)^<link") & _attribute(t, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)"))
        metas = F.filter(tags, lambda t: t.rlike(r"(?is)^<meta") & (F.lower(_attribute(t, "http-equiv")) == "refresh"))
        sent = F.transform(metas, lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)^\s*[0-9.]*\s*[;,]\s*(?:url\s*=)?\s*[\"']?([^\"']*)", 1))
        found = F.concat(F.transform(links, lambda t: _attribute(t, "href")), sent)
        return F.filter(F.transform(found, lambda h: _resolve(h, url)), lambda t: t.isNotNull())

    # Most pages name neither word: their HTML is passed by with one pattern.
    named = F.coalesce(html.rlike(r"(?i)canonical|http-equiv"), F.lit(False))
    return F.when(named, let(plain, hrefs)).otherwise(F.array().cast("array<string>"))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as a table: host, path, verdict."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _ints(values: list[int]) -> Column:
    return F.array(*(F.lit(n) for n in values)).cast("array<int>")


def judge(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct ``url`` rows to url, host, path, rule (``host`` and path prefix together, null if none fits) and verdict (null likewise)."""
    one = F.max(F.struct((F.char_length("host") + F.char_length("path")).alias("long"), F.char_length("host").alias("wide"), (F.col("verdict") == "allow").alias("open"), "verdict"))
    fixed = rules.groupBy(F.concat("host", "path").alias("name"), F.col("host").alias("of"), F.col("path").alias("prefix")).agg(one.alias("best"))
    shape = rules.agg(F.sort_array(F.collect_set(F.char_length("path"))).alias("lengths"), F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("depths")).first()
    parts = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    deep = F.filter(_ints(shape.depths), lambda n: F.size(labels) >= n)
    suffixes = F.transform(deep, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    fits = F.filter(_ints(shape.lengths), lambda n: F.char_length("path") >= n)
    prefixes = F.transform(fits, lambda n: F.substring(F.col("path"), F.lit(1), n))
    tries = parts.where("host <> ''").select("url", F.explode(suffixes).alias("of"), prefixes.alias("prefixes")).select("url", "of", F.explode("prefixes").alias("prefix"))
    won = tries.join(fixed, ["of", "prefix"]).groupBy("url").agg(F.max(F.struct("best.long", "best.wide", "best.open", "name", "best.verdict")).alias("won"))
    return parts.join(won, "url", "left").select("url", "host", "path", F.col("won.name").alias("rule"), F.col("won.verdict").alias("verdict"))


def verdicts(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Per page: page_id, url, host, path, rule, verdict, and ``alias_blocked`` (some URL of its component is blocked by a rule).
    ``redirects`` is an optional table of (source, target)."""
    read = cut(pages.select(pages["page_id"], pages["url"], link_targets(pages["url"], pages["html"]).alias("targets")))
    edges = read.select(F.col("url").alias("source"), F.explode("targets").alias("target"))
    if redirects is not None:
        edges = edges.unionByName(redirects.select("source", "target"))
    edges = cut(edges.distinct())
    urls = read.select("url").unionByName(edges.select(F.col("source").alias("url"))).unionByName(edges.select(F.col("target").alias("url")))
    judged = cut(judge(urls.where("url IS NOT NULL").distinct(), rules))
    linked = edges.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    found = connected_components(linked)
    # Nodes without edges aren't listed as components: they are their own.
    nodes = judged.select(node_of(F.col("url")).alias("of"), (F.col("verdict") == "block").alias("block")).where("of IS NOT NULL")
    placed = nodes.groupBy("of").agg(F.bool_or("block").alias("block")).join(found, F.col("of") == F.col("node"), "left")
    placed = placed.select(F.col("of"), F.coalesce("component", "of").alias("component"), "block")
    blocked = placed.where("block").select(F.col("component").alias("bad")).distinct()
    spread = placed.join(blocked, F.col("component") == F.col("bad"), "left_semi").select("of", F.lit(True).alias("spread"))
    full = judged.withColumn("node", node_of(F.col("url"))).join(spread, F.col("node") == F.col("of"), "left").select(
        F.col("url").alias("known"), "host", "path", "rule", "verdict", F.coalesce("spread", F.lit(False)).alias("spread")
    )
    aliased = F.coalesce("spread", F.lit(False))
    return read.join(full, F.col("url") == F.col("known"), "left").select(
        "page_id", "url", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("verdict", F.when(aliased, "block").otherwise("allow")).alias("verdict"), aliased.alias("alias_blocked"),
    )


def report(pages: DataFrame) -> DataFrame:
    return verdicts(pages, rule_table(pages.sparkSession)).drop("url")
