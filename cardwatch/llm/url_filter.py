"""Allow and block rules for urls, carried over redirects and canonical links, with DataFrame functions only.

Pages that redirect to each other or name each other as canonical are one page under several addresses. The links are
edges between urls; connected components of these edges are found by joins and minima, and a block of one address holds
for all addresses of its component unless a rule allows one of them. A rule for the address itself always comes first.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.components import connected_components
from cardwatch.llm.lines import ascii_lower
from cardwatch.sources.session import materialize

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host and all its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one or for null."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The text of the longest rule that fits, else null; of equal lengths that with the longer host.

    The rules are part of the plan, so this takes no join. They are meant to be a list kept by hand.
    """
    fits = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), len(r.host))):
        at_host = (host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))
        fits = F.when(at_host & F.startswith(path, F.lit(rule.path)), F.lit(rule.text)).otherwise(fits)
    return fits


def verdict_of(rule: Column, rules: list[Rule]) -> Column:
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(rule == r.text, F.lit(r.verdict)).otherwise(out)
    return out


def address(url: Column) -> Column:
    """What makes two urls the same address: host, path and query. Scheme, fragment and case of the host do not; an
    empty path is that of the root."""
    path = path_of(url)
    query = F.regexp_extract(after_scheme(url), r"^[^?#]*(\?[^#]*)", 1)
    return F.concat(host_of(url), F.when(path == "", F.lit("/")).otherwise(path), query)


def resolved(link: str, scheme: str, root: str, path: str) -> Column:
    """The absolute url of the column ``link`` on a page whose url has these parts; null for an empty link, one to the
    page itself or one without a host."""
    target, own = F.col(link), F.concat(F.col(scheme), F.lit("://"), F.col(root))
    return (
        F.when((target == "") | target.startswith("#"), F.lit(None).cast("string"))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.col(scheme), F.lit(":"), target))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("/"), F.concat(own, target))
        .when(target.startswith("?"), F.concat(own, F.col(path), target))
        .otherwise(F.concat(own, F.regexp_extract(path, r"^(.*/)", 1), target))
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a tag, in quotes or without; empty if it is not there."""

    def form(value):
        return F.regexp_extract(tag, rf"(?i)[\s\"']{name}\s*=\s*{value}", 1)

    values = [form(v) for v in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")]
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


#: Parts of a page whose content is no tag.
_HIDDEN = r"(?is)<!--.*?-->|<script[\s>].*?</script|<style[\s>].*?</style|<template[\s>].*?</template|<noscript[\s>].*?</noscript"
_TAGS = r"(?i)(<(?:link|meta)\s[^>]*>)"


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source`` and ``target`` urls of the canonical links and the redirects of all pages.

    Canonical links are ``<link rel=canonical href=…>``, redirects ``<meta http-equiv=refresh content="0; url=…">``, outside
    of comments, scripts, styles, templates and noscript. Pages with a null or relative url or a null html have none. The
    target is null where a link leads nowhere.
    """
    url, html = F.col(f"`{url_col}`"), F.col(f"`{html_col}`")
    rows = pages.where(url.contains("://") & html.rlike("(?i)canonical|refresh")).select(
        url.alias("source"),
        F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1).alias("scheme"),
        F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0).alias("root"),
        F.coalesce(F.nullif(path_of(url), F.lit("")), F.lit("/")).alias("path"),
        F.explode(F.regexp_extract_all(F.regexp_replace(html, _HIDDEN, " "), F.lit(_TAGS), F.lit(1))).alias("tag"),
    )
    tag = F.col("tag")
    is_link = tag.rlike("(?i)^<link")
    is_canonical = is_link & attribute(tag, "rel").rlike(r"(?i)(^|\s)canonical(\s|$)")
    is_refresh = ~is_link & attribute(tag, "http-equiv").rlike(r"(?i)^\s*refresh\s*$")
    wait = r"(?i)^\s*[0-9.]+\s*[;,]\s*url\s*=\s*[\"']?([^\"']*)"
    link = F.when(is_canonical, attribute(tag, "href")).when(is_refresh, F.regexp_extract(attribute(tag, "content"), wait, 1))
    # A generator keeps the optimiser from writing out the expression in every place that reads its column.
    links = rows.select("source", "scheme", "root", "path", F.explode_outer(F.array(F.btrim(F.replace(link, F.lit("&amp;"), F.lit("&"))))).alias("link"))
    return links.where("link IS NOT NULL").select("source", resolved("link", "scheme", "root", "path").alias("target"))


def blocked_addresses(links: DataFrame, rules: list[Rule]) -> DataFrame:
    """``address`` of all urls of ``links`` (source, target) whose component holds a blocked and no allowed url.

    An address may have any number of aliases: it is never gathered, only the minimum and the two votes of a component
    are, and these are combined before the shuffle.
    """
    both = links.where("target IS NOT NULL").select(
        *[f(F.col(c)).alias(f"{c}_{name}") for c in ("source", "target") for name, f in
          (("address", address), ("host", host_of), ("path", path_of))]
    )
    both = materialize(both.distinct())
    ends = [both.select(*[F.col(f"{c}_{name}").alias(name) for name in ("address", "host", "path")]) for c in ("source", "target")]
    rule = rule_for(F.col("host"), F.col("path"), rules)
    votes = ends[0].union(ends[1]).distinct().select("address", verdict_of(rule, rules).alias("vote"))
    components = connected_components(both.select(F.col("source_address").alias("a"), F.col("target_address").alias("b")))
    members = materialize(votes.join(components.withColumnRenamed("node", "address"), "address"))
    kinds = members.groupBy("component").agg(F.min("vote").alias("least"), F.max("vote").alias("most"))
    # The names of the verdicts sort allow before block.
    blocked = kinds.where((F.col("least") == BLOCK) & (F.col("most") == BLOCK)).select("component")
    return members.join(blocked, "component").select("address").distinct()


def judge_urls(pages: DataFrame, rules: list[Rule], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The table with ``host``, ``path``, ``rule`` and ``verdict``, which replace columns of those names.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered, the path what
    follows up to ``?``, ``#`` or the end; both are empty for a url that is null or has no ``://``. A url with a rule gets
    its verdict. Another is blocked if it is an alias of a blocked url and of no allowed one, else allowed; the urls of
    links need not be in the table. Urls of any length and repeated rows are kept as they are.
    """
    added = ["host", "path", "rule", "verdict"]
    url = F.col("url")
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in added]).alias("row"), F.col(f"`{url_col}`").alias("url")
    )
    named = rows.select("row", "url", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = named.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    blocked = materialize(blocked_addresses(materialize(page_links(pages, url_col, html_col)), rules))
    alias = F.when(F.col("rule").isNull(), address(url))
    judged = ruled.withColumn("alias", alias).join(blocked.withColumn("linked", F.lit(True)).withColumnRenamed("address", "alias"), "alias", "left")
    method = F.when(F.col("linked"), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), method)
    kept = [F.col(f"row.`{c}`").alias(c) for c in pages.columns if c not in added]
    return judged.select(*kept, "host", "path", "rule", verdict.alias("verdict"))
