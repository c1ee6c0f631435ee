"""URL rules with redirect equivalence.

A rule has a host, which also stands for its subdomains, and the beginning of a path; the longest fitting rule judges a
URL. URLs that redirects or canonical links tie together are aliases, whatever way they are spelled: connected components over those edges carry a
block to all members, but a member with an allow rule of its own stays allowed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.columns import let
from pagemill.functions.nodes import html_nodes, select_nodes
from pagemill.functions.text import trim_text
from pagemill.functions.urls import resolve_url
from pagemill.llm.common import connected_components, saved
from pagemill.operators.joins import lookup_join

# Verdict, host, beginning of the path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Pages without any of this name no alias: the words, or an attribute that spells them with entities.
NAMES_ALIAS = r"""(?i)canonical|refresh|(?:rel|http-equiv)\s*=\s*["']?[^"'>]{0,200}&"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_of(url: Column) -> Column:
    """Host, A to Z lower-cased; empty for null and for a URL without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path, up to the query or fragment; empty where there is none."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct<rule, verdict>`` of the longest rule (host and path together) that fits, else null. Of two equally long
    ones allow wins. ``rules`` is a short list; it becomes part of the expression."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1]))
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, rule_host, rule_path in reversed(ordered):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        result = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, result).otherwise(found)
    return found


def address(url: Column) -> Column:
    """What identifies a page: its URL in one form, however it was written: illegal characters of the path are
    percent-encoded, scheme and host are in lower case, an empty path is ``/``, and there is no fragment. A URL that cannot
    be taken apart stays as it is; null without ``://``."""

    def named(u: Column) -> Column:
        path = F.when(path_of(u) == "", F.lit("/")).otherwise(path_of(u))
        query = F.regexp_extract(_rest(u), r"^[^?#]*(\?[^#]*)", 1)
        return F.concat(F.lower(F.substring_index(u, "://", 1)), F.lit("://"), host_of(u), path, query)

    return F.when(F.instr(url, "://") > 0, let(F.coalesce(resolve_url(url, url), url), named))


def _targets(dom: Column) -> Column:
    """References of canonical links and of refresh tags in a parsed page."""
    attribute = lambda n, name: F.coalesce(n["attrs"][name], F.lit(""))
    canonical = F.filter(
        select_nodes(dom, "link[rel]"),
        lambda n: F.array_contains(F.split(F.lower(attribute(n, "rel")), r"[\t\n\f\r ]+"), "canonical"),
    )
    refresh = F.filter(select_nodes(dom, "meta[http-equiv]"), lambda n: F.lower(trim_text(attribute(n, "http-equiv"))) == "refresh")
    asked = lambda n: F.regexp_extract(attribute(n, "content"), r"(?is)[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1)
    found = F.concat(F.transform(canonical, lambda n: attribute(n, "href")), F.transform(refresh, asked))
    return F.filter(F.transform(found, trim_text), lambda x: x != "")


def alias_edges(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """Edges ``(a, b)`` between addresses: canonical links and refresh tags of ``pages`` (``url``, ``html``), and the
    rows of ``redirects`` (``url``, ``target``). Only pages that name one of them, or may with entities, are parsed."""
    marked = pages.select("url", "html").filter(F.col("url").isNotNull() & F.col("html").rlike(NAMES_ALIAS))
    parsed = marked.select("url", html_nodes(F.col("html")).alias("dom"))
    linked = parsed.select("url", F.explode(_targets(F.col("dom"))).alias("target"))
    if redirects is not None:
        linked = linked.unionByName(redirects.select("url", "target"))
    target = let(resolve_url(F.col("url"), F.col("target")), address)
    edges = linked.select(address(F.col("url")).alias("a"), target.alias("b"))
    return edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b")


def blocked_aliases(edges: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Addresses in a component of ``edges`` that holds a blocked one: ``address``."""
    parts = saved(connected_components(edges))
    rule = longest_rule(host_of(F.col("node")), path_of(F.col("node")), rules)
    roots = parts.filter(rule["verdict"] == "block").select("root").distinct()
    return parts.join(roots, "root", "left_semi").select(F.col("node").alias("address"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages`` (``page_id``, ``url``, ``html``).

    The verdict is the rule's; without a rule it is block for an alias of a blocked address, else allow. A null URL, or
    one without ``://``, has empty host and path, fits no rule and has no alias: allow. Null HTML names no alias.
    Repeated rows are judged one by one; other columns are not read.
    """
    blocked = saved(blocked_aliases(alias_edges(pages, redirects), rules).withColumn("_blocked", F.lit(True)))
    judged = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("address")
    ).withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    joined = lookup_join(judged, blocked, ["address"], "left", materialized=True)
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("_blocked"), F.lit("block")), F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))
