"""A crawl that goes on while pages arrive: links found are fed back as a second input of the frontier."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pagemill.operators.joins import lookup_join, reliable_checkpoint
from pagemill.operators.links import crawlable_links
from pagemill.operators.robots import robots_allowed
from pagemill.plans.crawl import CrawlResult, without_barred
from pagemill.plans.documents import documents_with_outcome
from pagemill.schema import DOCUMENT_SCHEMA, FRONTIER_SCHEMA
from pagemill.sources.batches import BatchTable
from pagemill.streaming.state import run_batches

EDGE_SCHEMA = T.StructType([T.StructField("url", T.StringType()), T.StructField("targets", T.ArrayType(T.StringType()))])
MOVE_SCHEMA = T.StructType([*FRONTIER_SCHEMA, T.StructField("follow", T.BooleanType())])
LINKS = T.ArrayType(
    T.StructType([T.StructField("ord", T.IntegerType()), T.StructField("href", T.StringType()), T.StructField("url", T.StringType())])
)
HELD = T.StructType([T.StructField("depth", T.IntegerType()), T.StructField("targets", T.ArrayType(T.StringType()))])


class Reach(StatefulProcessor):
    """Smallest depth of a URL and the links of its page. A smaller depth comes out as a reached URL (``follow`` false)
    and sends all links on; new links of a URL that is reached already are sent on as they come."""

    def __init__(self, max_depth: int):
        self.max_depth = max_depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before, known = self.state.get() if self.state.exists() else (None, [])
        depth, targets = before, set(known or [])
        for row in rows:
            if row["depth"] is not None:
                depth = row["depth"] if depth is None else min(depth, row["depth"])
            targets.update(row["targets"] or [])
        self.state.update((depth, sorted(targets)))
        if depth != before:
            yield Row(url=key[0], depth=depth, follow=False)
        if depth is not None and depth < self.max_depth:
            for target in sorted(targets if depth != before else targets - set(known or [])):
                yield Row(url=target, depth=depth + 1, follow=True)

    def close(self) -> None:
        pass


def stream_crawl(
    pages: DataFrame,
    seeds: DataFrame,
    root: str,
    max_depth: int,
    robots: DataFrame | None = None,
    content_tags: Sequence[str] = (),
    excluded_domains: Sequence[str] | DataFrame = (),
    ad_patterns: Sequence[str] = (),
    limits: Mapping[str, int] | None = None,
    embed: Callable[[Column], Column] | None = None,
    dimension: int | None = None,
) -> CrawlResult:
    """Crawl the pages that have arrived so far, from ``seeds`` (``url, depth``), and return what `crawl_documents`
    returns for all of them (one page per URL). Calling this again goes on with new pages and new seeds.

    Pages are parsed once, as they land, reached or not; a page may arrive before or after its URL is reached. The state is
    kept per URL: its smallest depth so far and the links of its page, no body. Links of reached pages are written as
    new rows of the frontier, one per URL and batch, and read by the same query until none comes. A URL that is reached
    again at a smaller depth sends its links on again, at most ``max_depth`` times. ``robots`` is the table of `robots_rules`.
    All tables are batch tables under ``root``, so a batch that runs again after a crash leaves its rows once.
    """
    spark = pages.sparkSession
    more = [("reject_reason", T.StringType()), ("_barred", T.BooleanType()), ("links", LINKS)]
    crawled_schema = T.StructType([*DOCUMENT_SCHEMA, *[T.StructField(n, t) for n, t in more]])
    crawled = BatchTable(spark, f"{root}/crawled", crawled_schema)
    edges = BatchTable(spark, f"{root}/edges", EDGE_SCHEMA)
    start = BatchTable(spark, f"{root}/seeds", FRONTIER_SCHEMA)
    frontier = BatchTable(spark, f"{root}/frontier", FRONTIER_SCHEMA)
    moves = BatchTable(spark, f"{root}/moves", MOVE_SCHEMA)

    def land(batch: DataFrame, number: int) -> None:
        if number not in crawled.committed([number]):
            table = documents_with_outcome(batch, content_tags, limits, embed, dimension, links=True)
            barred = F.lit(None).cast("boolean")
            if robots is not None:
                table = robots_allowed(table, robots)
                barred = F.when(~F.col("allowed") & ~F.col("reject_reason").eqNullSafe("bad_url"), F.lit(True))
            crawled.write(table.withColumn("_barred", barred).select(*crawled_schema.names), number)
        table = crawled.read([number]).filter(F.col("_barred").isNull())
        links = table.select(F.col("url").alias("src_url"), F.inline("links"))
        follow = crawlable_links(links, excluded_domains, ad_patterns)
        # one row per page: at most the links of its body
        edges.write(follow.groupBy(F.col("src_url").alias("url")).agg(F.collect_set("url").alias("targets")), number)

    for table in (edges, start, frontier):  # so that there is something to read before the first row
        table.write(spark.createDataFrame([], table.schema), -1)
    run_batches(pages, land, f"{root}/_progress/pages")
    fresh = reliable_checkpoint(seeds.select("url", F.col("depth").cast("int")).exceptAll(start.read().select("url", "depth")))
    if not fresh.isEmpty():
        start.write(fresh, start.next_batch())

    fed: list[bool] = []

    def step(batch: DataFrame, number: int) -> None:
        found = moves.write(batch.select(*MOVE_SCHEMA.names), number, again=True)
        onward = found.filter("follow").groupBy("url").agg(F.min("depth").alias("depth"))
        fed.append(not frontier.write(onward, number, again=True).isEmpty())

    none = F.lit(None).cast("array<string>").alias("targets")
    arrivals = [t.stream().select("url", "depth", none) for t in (start, frontier)]
    known = edges.stream().select("url", F.lit(None).cast("int").alias("depth"), "targets")
    events = arrivals[0].unionByName(arrivals[1]).unionByName(known)
    reach = events.groupBy("url").transformWithState(Reach(max_depth), MOVE_SCHEMA, "Update", "None")
    while True:
        fed.clear()
        run_batches(reach, step, f"{root}/_progress/frontier", "update")
        if not any(fed):
            break

    reached = moves.read().filter("NOT follow").groupBy("url").agg(F.min("depth").alias("depth"))
    reached = reliable_checkpoint(reached)
    table = crawled.read().drop("batch", "links")
    found = lookup_join(table, reached, ["url"], "inner", materialized=True)
    documents = without_barred(found) if robots is not None else found
    missing = lookup_join(reached, table.select("url"), ["url"], "left_anti")
    return CrawlResult(reached, documents.select(*DOCUMENT_SCHEMA.names, "depth", "reject_reason"), missing)
