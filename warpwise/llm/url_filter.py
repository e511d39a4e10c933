"""URL filters with redirect equivalence.

Rules of a host and a path prefix, each allow or block, fit the host and its subdomains; the longest fitting
rule decides. URLs that redirect to each other, or name each other as their canonical address, are aliases:
connected components over these links carry the block of one member to all members, except those
that a rule of their own allows. URLs without rule and without blocked alias are allowed.

Links are read from the pages: ``<link rel=canonical href=...>``, also among several rel words, and
``<meta http-equiv=refresh content="...; url=...">``. An attribute is read up to its closing quote. A node is host and path, so scheme, query and fragment make no difference.

Rules meet URLs by an equi-join on the suffixes of the host (a host of n labels has n), so no URL is held
against all rules. The rules are broadcast up to BROADCAST_RULES, beyond that Spark chooses the join.

Defined cases: a null URL or one without ``://`` has empty host and path, no rule and no aliases; null or
broken markup has no links; relative links are resolved against host and directory, with ``.`` and ``..``; targets of other schemes
(``mailto:``) are no links; repeated
pages get the same verdict; rules that differ in action only are both kept, and block wins between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..runtime import materialise
from .columns import column, free, without
from .components import connected_components

BROADCAST_RULES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to a slash, question mark or hash, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to a question mark or hash; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _suffixes(host: Column) -> Column:
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct (host, path) of ``urls`` that a rule fits, with the longest fitting one: rule, action.

    ``rules`` has host, path (with its leading slash) and action; a rule's name is host and path.
    """
    rules = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), "action")
    rules = F.broadcast(rules) if rules.count() <= BROADCAST_RULES else rules
    name = F.concat("suffix", "prefix")
    fitting = (
        urls.select("host", "path")
        .where("host <> ''")
        .distinct()
        .select("host", "path", F.explode(_suffixes(F.col("host"))).alias("suffix"))
        .join(rules, "suffix")
        .where(F.col("path").startswith(F.col("prefix")))
    )
    best = fitting.groupBy("host", "path").agg(
        F.max(F.struct(F.length(name).alias("n"), (F.col("action") == "block").alias("b"), name.alias("rule"), "action")).alias("best")
    )
    return best.select("host", "path", "best.rule", "best.action")


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, up to its closing quote, or to a space where it has none; else empty."""
    start = rf"(?is)\s{name}\s*=\s*"
    parts = [F.regexp_extract(tag, start + value, 1) for value in (r'"([^"]*)"', r"'([^']*)'", r"([^\"'\s>][^\s>]*)")]
    return F.coalesce(*[F.nullif(F.trim(p), F.lit("")) for p in parts], F.lit(""))


def _without_dots(path: Column) -> Column:
    """A path whose ``.`` segments are dropped and whose ``..`` segments take the one before with them."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    none = F.array().cast("array<string>")

    def step(kept, segment):
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", up).when(segment == ".", kept).otherwise(F.array_append(kept, segment))

    closed = F.when(path.rlike(r"/\.\.?$"), F.lit("/")).otherwise("")
    whole = F.concat(F.lit("/"), F.array_join(F.aggregate(segments, none, step), "/"))
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.when(whole == "/", whole).otherwise(F.concat(whole, closed))).otherwise(path)


def _resolved(target: Column, host: Column, path: Column) -> Column:
    """A link's target as an absolute URL; null for a target of another kind, such as ``mailto:``."""
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(F.lit("http://"), host, target))
        .when(target.rlike("^[?#]"), F.concat(F.lit("http://"), host, path, target))
        .otherwise(F.concat(F.lit("http://"), host, F.coalesce(F.nullif(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.lit("")), F.lit("/")), target))
    )


def alias_links(pages: DataFrame) -> DataFrame:
    """(host, path, to_host, to_path) of the canonical and redirect links in ``pages`` (host, path, html)."""

    def tags(name: str) -> Column:
        return F.regexp_extract_all("html", F.lit(rf"(?is)<{name}\s[^>]*>"), F.lit(0))

    def canonical(tag: Column) -> Column:
        rel = F.lower(_attribute(tag, "rel"))
        return F.when(rel.rlike(r"(^|\s)canonical(\s|$)"), _attribute(tag, "href")).otherwise("")

    def redirect(tag: Column) -> Column:
        url = F.regexp_extract(_attribute(tag, "content"), r"(?is)^[^;,]*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1)
        return F.when(F.lower(_attribute(tag, "http-equiv")) == "refresh", F.trim(url)).otherwise("")

    found = F.concat(F.transform(tags("link"), canonical), F.transform(tags("meta"), redirect))
    links = pages.where("html is not null and host <> ''").select("host", "path", F.explode(found).alias("target")).where("target <> ''")
    url = _resolved(F.col("target"), F.col("host"), F.col("path"))
    ends = links.select("host", "path", host_of(url).alias("to_host"), _without_dots(path_of(url)).alias("to_path"))
    return ends.where("to_host <> '' and not (host = to_host and path = to_path)").distinct()


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with host, path, rule and verdict; columns of these names are replaced, the markup is dropped."""
    spark = pages.sparkSession
    carried = without(pages, ["host", "path", "rule", "verdict", html])
    markup, name, action, named, shut = (free(pages, n) for n in ("__html", "__rule", "__action", "__node", "__blocked"))
    located = pages.select(
        *[column(c) for c in carried], column(html).alias(markup), host_of(column(url)).alias("host"), path_of(column(url)).alias("path")
    )
    links = materialise(alias_links(located.select("host", "path", F.col(markup).alias("html"))), "alias-links")
    ends = links.select("host", "path").unionByName(links.select(F.col("to_host").alias("host"), F.col("to_path").alias("path")))
    ruled = materialise(with_rules(located.select("host", "path").unionByName(ends), rules), "ruled-urls")

    node = F.concat("host", "path")  # a path is empty or begins with a slash, a host has none
    edges = links.select(node.alias("u"), F.concat("to_host", "to_path").alias("v"))
    parts = materialise(connected_components(edges), "aliases")
    blocked = ruled.where("action = 'block'").select(node.alias("node")).join(parts, "node").select("component").distinct()
    aliases = parts.join(blocked, "component", "left_semi").select(F.col("node").alias(named), F.lit(True).alias(shut))

    own = ruled.select("host", "path", F.col("rule").alias(name), F.col("action").alias(action))
    rest = located.drop(markup).join(own, ["host", "path"], "left").withColumn(named, node)
    verdict = F.coalesce(action, F.when(F.col(shut), "block"), F.lit("allow"))
    return rest.join(aliases, named, "left").select(
        *[column(c) for c in carried], "host", "path", F.col(name).alias("rule"), verdict.alias("verdict")
    )
