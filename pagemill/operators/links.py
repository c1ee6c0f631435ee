"""Link rows: extraction, resolution and the link filters."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.extract import extract_links, page_view
from pagemill.functions.nodes import html_nodes
from pagemill.functions.urls import hostname_suffixes, resolve_hrefs, url_hostname
from pagemill.operators.joins import BROADCAST_BYTES, ROWS_PER_KEY, lookup_join, reliable_checkpoint


def page_links(pages: DataFrame, selectors: Sequence[str] = ()) -> DataFrame:
    """One row per link to follow: ``src_url, ord, href, url`` with ``url`` absolute. Links that do not resolve
    are dropped. Only url and html are read; each page is parsed once.

    URLs are resolved inside the page row, before the links become rows: a filter on ``url`` then reads a finished
    value instead of resolving it again.
    """
    dom = pages.select("url", html_nodes(F.col("html")).alias("dom"))
    return link_rows(dom.select("url", page_view(F.col("dom"), selectors).alias("page")))


def link_rows(parsed: DataFrame) -> DataFrame:
    """Link rows of parsed pages (columns ``url`` and ``page``)."""
    hrefs = resolve_hrefs(F.col("url"), extract_links(F.col("page")))
    return parsed.select(F.col("url").alias("src_url"), F.inline(hrefs))


def same_host(links: DataFrame, base: str = "src_url", link: str = "url") -> DataFrame:
    """Keep a link iff its host name equals that of its page; port and scheme do not count, case does."""
    return links.filter(url_hostname(F.col(link)) == url_hostname(F.col(base)))


def any_of(tests: Sequence[Column]) -> Column:
    """True if one of the tests is; a balanced tree, so that thousands of them stay shallow."""
    tests = list(tests) or [F.lit(False)]
    while len(tests) > 1:
        pairs = [tests[k] | tests[k + 1] for k in range(0, len(tests) - 1, 2)]
        tests = pairs + tests[len(pairs) * 2 :]
    return tests[0]


def is_excluded(hostname: Column, domains: Sequence[str]) -> Column:
    """Suffix test without a dot boundary; '' excludes everything."""
    return any_of([hostname.endswith(d) for d in domains])


def not_excluded_domain(
    links: DataFrame,
    domains: Sequence[str] | DataFrame,
    link: str = "url",
    max_bytes: int = BROADCAST_BYTES,
    rows_per_key: int = ROWS_PER_KEY,
) -> DataFrame:
    """Drop links whose host name ends in an excluded domain.

    A list becomes one predicate. A table of domains (column ``domain``) is joined by equality: each distinct
    host name is cut into its endings of the lengths that occur in the table, and the host names that hit are then taken out of the links.
    """
    host = url_hostname(F.col(link))
    if not isinstance(domains, DataFrame):
        return links.filter(~is_excluded(host, domains)) if domains else links
    listed = reliable_checkpoint(domains.select(F.col("domain").alias("_suffix")).distinct())
    lengths = sorted(r[0] for r in listed.select(F.length("_suffix")).distinct().na.drop().collect())
    if not lengths:
        return links
    tagged = reliable_checkpoint(links.withColumn("_host", host))  # read twice below; links may come from parsing
    hosts = tagged.select("_host").distinct()
    endings = hosts.select("_host", F.explode(hostname_suffixes(F.col("_host"), lengths)).alias("_suffix"))
    hit = lookup_join(endings, listed, ["_suffix"], "left_semi", max_bytes, rows_per_key, materialized=True)
    hit = hit.select("_host").distinct()
    return lookup_join(tagged, hit, ["_host"], "left_anti", max_bytes, rows_per_key).drop("_host")


PATTERNS_JOINED = 200

# --- ad patterns ---------------------------------------------------------------------------------------------
# POSIX classes of the pattern dialect and their names in Java
POSIX_CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit",
    "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper",
    "xdigit": "XDigit",
}


def java_pattern(pattern: str) -> str:
    """The two spellings Java lacks: named groups (only matching counts, so the name goes) and POSIX classes."""
    pattern = re.sub(r"(?<!\\)\(\?P<\w+>", "(?:", pattern)
    return re.sub(r"\[:(\^?)(\w+):\]", _posix, pattern)


def _posix(m: re.Match) -> str:
    name = POSIX_CLASSES.get(m[2])
    if name is None:
        raise ValueError(f"unknown character class [:{m[2]}:]")
    return (r"\P{" if m[1] else r"\p{") + name + "}"


def compile_patterns(links: DataFrame, patterns: Sequence[str], on_bad_pattern: str = "error") -> list[str]:
    """Java spelling of every pattern, each compiled once by the JVM before the job starts, without a Spark job.
    ``error`` fails on an invalid pattern, ``ignore`` leaves it out."""
    compiler, good = links.sparkSession.sparkContext._jvm.java.util.regex.Pattern, []
    for p in patterns:
        try:
            java = java_pattern(p)
            compiler.compile(java)
        except Exception as e:
            if on_bad_pattern == "error":
                raise ValueError(f"invalid ad pattern {p!r}") from e
            continue
        good.append(java)
    return good


def joined_patterns(java_patterns: Sequence[str], size: int = PATTERNS_JOINED) -> list[str]:
    """Patterns joined into alternations of at most ``size``. One with a group number, a quotation or a comment flag
    would read differently next to others and stays alone."""
    alone = [p for p in java_patterns if re.search(r"\\[1-9kQ]|\(\?[a-z]*x", p)]
    free = [p for p in java_patterns if p not in set(alone)]
    parts = [free[k : k + size] for k in range(0, len(free), size)]
    return ["|".join(f"(?:{p})" for p in part) for part in parts] + alone


def is_ad_link(link: Column, java_patterns: Sequence[str]) -> Column:
    """Unanchored search of any pattern."""
    return any_of([link.rlike(p) for p in joined_patterns(java_patterns)])


def not_ad_link(
    links: DataFrame, patterns: Sequence[str], link: str = "url", on_bad_pattern: str = "error"
) -> DataFrame:
    """Drop links whose absolute URL matches any ad pattern."""
    good = compile_patterns(links, patterns, on_bad_pattern)
    return links.filter(~is_ad_link(F.col(link), good)) if good else links


def crawlable_links(
    links: DataFrame,
    excluded_domains: Sequence[str] | DataFrame = (),
    ad_patterns: Sequence[str] = (),
) -> DataFrame:
    """The three link filters, cheapest first."""
    return not_ad_link(not_excluded_domain(same_host(links), excluded_domains), ad_patterns)
