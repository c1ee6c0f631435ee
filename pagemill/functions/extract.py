"""Document columns from an element table. Everything here is native and map-only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.columns import let
from pagemill.functions.nodes import first_node, outside, select_nodes, starts_of, strictly_inside, text_slice, text_without
from pagemill.functions.text import clean_text, trim_text
from pagemill.functions.urls import resolve_url

# --- fixed values -------------------------------------------------------------------------------------------
FALLBACK_BLOCKS = "article, main, section, p, h1, h2, h3"
BOILERPLATE = "script, style, nav, footer, aside, .adsbygoogle"
MIN_BLOCK_BYTES = 50
METADATA_TAGS = ("a", "h1", "h2", "h3", "h4", "h5", "h6", "html", "link", "meta", "time", "title")
HEADING_TAGS = "h1, h2, h3, h4, h5, h6"
HEADING_SEPARATOR = " | "
DATE_METAS = (
    "meta[property='article:published_time']",
    "meta[name='pubdate']",
    "meta[name='sailthru.date']",
)
DATE_TIME = r"^(\d{4}-\d\d-\d\d)T(\d{1,2}):(\d\d):(\d\d)(?:[.,]\d+)?(?:Z|([+-])(\d\d):(\d\d))$"
DATE_ONLY = r"^\d{4}-\d\d-\d\d$"
# ------------------------------------------------------------------------------------------------------------


def _attribute(dom: Column, selector: str, name: str) -> Column:
    return F.coalesce(first_node(dom, selector)["attrs"][name], F.lit(""))


# --- main content -------------------------------------------------------------------------------------------
def _configured(dom: Column, selectors: Sequence[str]) -> Column:
    """Matches of the configured selectors: selector order, then document order."""
    if not selectors:
        return F.slice(dom["nodes"], 1, 0)
    return F.concat(*[select_nodes(dom, s) for s in selectors])


def _configured_text(text: Column, found: Column) -> Column:
    blocks = F.transform(found, lambda n: F.concat(text_slice(text, n["start"], n["stop"]), F.lit("\n")))
    return clean_text(F.array_join(blocks, ""))


def _fallback_text(text: Column, blocks: Column, boilerplate: Column) -> Column:
    texts = let(
        starts_of(boilerplate),
        lambda starts: F.transform(blocks, lambda n: trim_text(text_without(text, n, boilerplate, starts))),
    )
    long_texts = F.filter(texts, lambda b: F.octet_length(b) > MIN_BLOCK_BYTES)
    return clean_text(F.array_join(F.transform(long_texts, lambda b: F.concat(b, F.lit("\n\n"))), ""))


def _fallback_parts(dom: Column) -> Column:
    return F.struct(
        select_nodes(dom, FALLBACK_BLOCKS).alias("blocks"), select_nodes(dom, BOILERPLATE).alias("boilerplate")
    )


def main_content_tags(dom: Column, selectors: Sequence[str]) -> Column:
    """Cleaned text of all matches of the configured selectors. Nested matches repeat their text and text of
    scripts inside a match counts. NULL when nothing matches."""
    return let(
        _configured(dom, selectors),
        lambda found: F.when(F.size(found) > 0, _configured_text(dom["text"], found)),
    )


def main_content_fallback(dom: Column) -> Column:
    """Cleaned text of the semantic blocks longer than 50 bytes, each without the boilerplate inside it."""
    return let(_fallback_parts(dom), lambda p: _fallback_text(dom["text"], p["blocks"], p["boilerplate"]))


def extract_main_content(dom: Column, selectors: Sequence[str] = ()) -> Column:
    """Configured selectors first; the fallback only when none of them matched any element, so an empty match
    gives ''."""
    return F.coalesce(main_content_tags(dom, selectors), main_content_fallback(dom))


def page_view(dom: Column, selectors: Sequence[str] = ()) -> Column:
    """The page as metadata and links see it: ``struct<main_content, text, nodes, cut>``.

    The fallback takes boilerplate out of the page for good. ``cut`` holds the removed elements (empty when the
    fallback did not run). ``nodes`` are the elements the functions below read, without the removed ones and
    what is inside them.
    """
    text, nodes = dom["text"], dom["nodes"]
    read = F.filter(nodes, lambda n: n["tag"].isin(*METADATA_TAGS))

    def view(content: Column, left: Column, cut: Column) -> Column:
        return F.struct(
            content.alias("main_content"), text.alias("text"), left.alias("nodes"), cut.alias("cut")
        )

    def with_fallback(p: Column) -> Column:
        removed = strictly_inside(p["boilerplate"], p["blocks"])
        return let(
            removed,
            lambda cut: view(
                _fallback_text(text, p["blocks"], p["boilerplate"]),
                outside(read, cut),
                cut,
            ),
        )

    return let(
        _configured(dom, selectors),
        lambda found: F.when(
            F.size(found) > 0, view(_configured_text(text, found), read, F.slice(nodes, 1, 0))
        ).otherwise(let(_fallback_parts(dom), with_fallback)),
    )


def _text(page: Column, node: Column) -> Column:
    return text_without(page["text"], node, page["cut"])


# --- metadata (``page`` is the column of `page_view`) ----------------------------------------------------
def extract_title(page: Column) -> Column:
    titles = F.transform(F.slice(select_nodes(page, "title"), 1, 1), lambda n: trim_text(_text(page, n)))
    return F.coalesce(F.get(titles, 0), F.lit(""))


def extract_meta_description(page: Column) -> Column:
    return trim_text(_attribute(page, "meta[name='description']", "content"))


def extract_canonical_url(page: Column, page_url: Column) -> Column:
    """Resolved against the page URL; '' when absent or not a valid reference."""
    href = trim_text(_attribute(page, "link[rel='canonical']", "href"))
    return let(
        href, lambda h: F.when(h == "", F.lit("")).otherwise(F.coalesce(resolve_url(page_url, h), F.lit("")))
    )


def extract_language(page: Column) -> Column:
    return trim_text(_attribute(page, "html", "lang"))


def publication_date_text(page: Column) -> Column:
    """First non-empty of the three meta dates, else the first ``time[datetime]`` whatever it holds."""
    metas = [F.nullif(_attribute(page, s, "content"), F.lit("")) for s in DATE_METAS]
    return F.coalesce(*metas, _attribute(page, "time[datetime]", "datetime"))


def parse_publication_ts(value: Column) -> Column:
    """Unix seconds of an RFC 3339 time or a plain date, NULL for anything else. Independent of the session
    time zone; fractions are dropped."""
    return let(value, _unix_seconds)


def _unix_seconds(value: Column) -> Column:
    def part(n: int) -> Column:
        return F.regexp_extract(value, DATE_TIME, n)

    def number(n: int) -> Column:
        return F.nullif(part(n), F.lit("")).cast("int")

    clock = F.concat(part(1), F.lit("T"), F.lpad(part(2), 2, "0"), F.lit(":"), part(3), F.lit(":"), part(4), F.lit("Z"))
    offset = F.when(part(5) == "", F.lit(0)).when(
        (number(6) <= 24) & (number(7) <= 60),
        F.when(part(5) == "-", F.lit(-60)).otherwise(F.lit(60)) * (number(6) * 60 + number(7)),
    )
    return F.when(
        value.rlike(DATE_TIME), F.unix_seconds(F.try_to_timestamp(clock)) - offset
    ).when(
        value.rlike(DATE_ONLY), F.unix_seconds(F.try_to_timestamp(F.concat(value, F.lit("T00:00:00Z"))))
    )


def extract_publication_ts(page: Column) -> Column:
    return parse_publication_ts(publication_date_text(page))


def extract_headings(page: Column) -> Column:
    texts = F.transform(select_nodes(page, HEADING_TAGS), lambda n: trim_text(_text(page, n)))
    return F.array_join(texts, HEADING_SEPARATOR)


def extract_links(page: Column) -> Column:
    """``array<struct<ord, href>>`` of the links to follow, in document order; in-page and javascript links are
    skipped (tested on the raw attribute)."""
    hrefs = F.transform(
        F.filter(select_nodes(page, "a[href]"), lambda n: is_followable(n["attrs"]["href"])),
        lambda n, k: F.struct((k + 1).alias("ord"), n["attrs"]["href"].alias("href")),
    )
    return hrefs


def is_followable(href: Column) -> Column:
    return ~(href.startswith("#") | F.lower(href).startswith("javascript:"))
