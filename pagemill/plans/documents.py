"""From captured pages to document rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import extract as X
from pagemill.functions.nodes import html_nodes
from pagemill.functions.text import content_hash
from pagemill.functions.urls import resolve_hrefs
from pagemill.operators.validate import document_reject_reason, page_reject_reason, zero_filled
from pagemill.schema import DOCUMENT_SCHEMA


def parsed_pages(pages: DataFrame, content_tags: Sequence[str] = (), usable: Column | None = None) -> DataFrame:
    """``pages`` with ``page``: the main content and the elements the metadata and link functions read. Rows that
    are not ``usable`` are kept but not parsed."""
    body = F.col("html") if usable is None else F.when(usable, F.col("html"))
    dom = pages.withColumn("dom", html_nodes(body))
    return dom.withColumn("page", X.page_view(F.col("dom"), content_tags)).drop("dom")


def to_documents(
    pages: DataFrame,
    content_tags: Sequence[str] = (),
    embed: Callable[[Column], Column] | None = None,
    dimension: int | None = None,
    extra: Sequence[str] = (),
    usable: Column | None = None,
    links: bool = False,
) -> DataFrame:
    """One 12-column document per page (plus the ``extra`` input columns). Map-only. With ``links`` the resolved links
    of the page are a last column, from the same parse.

    ``crawled_at`` is Unix seconds of ``fetched_at`` where the input has it, else of now. A missing date is 0.
    ``content_vector`` is empty unless ``embed`` is given, which then gets the main content; with ``dimension``
    an empty vector becomes zeros.
    """
    stamp = F.col("fetched_at") if "fetched_at" in pages.columns else F.current_timestamp()
    page, url = F.col("page"), F.col("url")
    content = page["main_content"]
    rows = parsed_pages(pages, content_tags, usable).select(
        content_hash(content).alias("hash_id"),
        url,
        F.col("html").alias("html_source"),
        content.alias("main_content"),
        X.extract_title(page).alias("title"),
        X.extract_meta_description(page).alias("meta_description"),
        X.extract_canonical_url(page, url).alias("canonical_url"),
        X.extract_language(page).alias("language"),
        F.coalesce(X.extract_publication_ts(page), F.lit(0)).cast("long").alias("publication_timestamp"),
        X.extract_headings(page).alias("headings_text"),
        F.unix_seconds(stamp).alias("crawled_at"),
        *extra,
        *([resolve_hrefs(url, X.extract_links(page)).alias("links")] if links else []),
    )
    vector = embed(F.col("main_content")) if embed else F.array().cast("array<float>")
    if dimension is not None:
        vector = zero_filled(vector, dimension)
    return rows.select(
        *DOCUMENT_SCHEMA.names[:-1], vector.alias("content_vector"), *extra, *(["links"] if links else [])
    )


def documents_with_outcome(
    pages: DataFrame,
    content_tags: Sequence[str] = (),
    limits: Mapping[str, int] | None = None,
    embed: Callable[[Column], Column] | None = None,
    dimension: int | None = None,
    drop_empty: bool = False,
    extra: Sequence[str] = (),
    links: bool = False,
) -> DataFrame:
    """One row per captured page: the document, or NULLs where the page is dropped before parsing, and
    ``reject_reason`` (NULL for a document to store). ``pages`` may have ``status`` and ``allowed``.

    One pass over the pages: a dropped page stays in its row and only its body is kept from the parser. With ``links``
    the links of the pages not dropped before parsing are a last column.
    """
    have = pages.columns
    early = page_reject_reason(
        F.col("url"),
        F.col("allowed") if "allowed" in have else None,
        F.col("status") if "status" in have else None,
    )
    tagged = pages.withColumn("reject_reason", early)
    docs = to_documents(
        tagged, content_tags, embed, dimension, [*extra, "reject_reason"], F.col("reject_reason").isNull(), links
    )
    late = document_reject_reason(limits, dimension)
    if drop_empty:
        late = F.when(F.col("main_content") == "", F.lit("empty_content")).otherwise(late)
    kept = ("url", "html_source", "crawled_at")
    columns = [
        F.col(c) if c in kept else F.when(F.col("reject_reason").isNull(), F.col(c)).alias(c)
        for c in DOCUMENT_SCHEMA.names
    ]
    found = [F.when(F.col("reject_reason").isNull(), F.col("links")).alias("links")] if links else []
    return docs.select(*columns, *extra, F.coalesce(F.col("reject_reason"), late).alias("reject_reason"), *found)
