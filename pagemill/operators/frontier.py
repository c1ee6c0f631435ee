"""Crawl frontier: one round, the cap, the fetch timetable."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import url_host
from pagemill.operators.joins import (
    BROADCAST_BYTES,
    ROWS_PER_KEY,
    heavy_keys,
    lookup_join,
    reliable_checkpoint,
    salt_big,
    salt_small,
)


def expand_frontier(
    frontier: DataFrame,
    links: DataFrame,
    visited: DataFrame,
    max_depth: int,
    max_bytes: int = BROADCAST_BYTES,
    rows_per_key: int = ROWS_PER_KEY,
) -> DataFrame:
    """One round: targets of the links (``src_url, url``) of frontier pages above ``max_depth`` that are not in
    ``visited``, each once, one level deeper than their shallowest source. ``visited`` stays where it is while the targets
    of a round measure little: those that it holds are looked up in them."""
    sources = frontier.filter(F.col("depth") < max_depth).select(F.col("url").alias("src_url"), "depth")
    found = lookup_join(links.select("src_url", "url"), sources, ["src_url"], "inner", max_bytes, rows_per_key)
    targets = reliable_checkpoint(found.groupBy("url").agg((F.min("depth") + 1).alias("depth")))
    known = lookup_join(
        visited.select("url"), targets.select("url"), ["url"], "left_semi", max_bytes, rows_per_key, materialized=True
    )
    return lookup_join(targets, known.distinct(), ["url"], "left_anti", max_bytes, rows_per_key)


def frontier_limit(frontier: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` pending URLs per round, the first by depth and URL. What is left out is not visited."""
    return frontier.orderBy("depth", "url").limit(cap)


def frontier_split(frontier: DataFrame, cap: int, rows_per_group: int = ROWS_PER_KEY) -> DataFrame:
    """``frontier`` with ``now``: true for the first ``cap`` URLs by depth and URL, false for those that stay pending.

    Whole depths are taken by their counts; only the URLs of the depth in which the cap falls are numbered, over many
    tasks where they are many.
    """
    counts = {r["depth"]: r["count"] for r in frontier.groupBy("depth").count().collect()}  # one row per depth
    room, whole, cut = cap, [], None
    for depth in sorted(counts):
        if counts[depth] <= room:
            whole.append(depth)
            room -= counts[depth]
        else:
            cut = depth
            break
    taken = frontier.withColumn("now", F.col("depth").isin(whole) if whole else F.lit(False))
    if cut is None:
        return taken
    ranked = numbered_by_group(frontier.filter(F.col("depth") == cut), "depth", ["url"], rows_per_group)
    ranked = ranked.select(*frontier.columns, (F.col("_rn") <= room).alias("now"))
    return taken.filter(F.col("depth") != cut).unionByName(ranked)


class _Seen:
    """URLs found so far, a part per round, each kept partitioned by URL: a test against them moves nothing of theirs.
    The parts come from checkpoints, so those lost with an executor are read back."""

    def __init__(self, partitions: int):
        self.partitions, self.parts = partitions, []

    def add(self, urls: DataFrame) -> None:
        part = urls.select("url").repartition(self.partitions, "url").persist()
        part.count()  # the joins see the partitioning only once the part is there
        self.parts.append(part)

    def new(self, urls: DataFrame) -> DataFrame:
        """Those of ``urls`` (one column) that are in no part, each once: one exchange of ``urls``."""
        urls = urls.repartition(self.partitions, "url").distinct()
        for part in self.parts:
            urls = urls.join(part.hint("shuffle_hash"), "url", "left_anti")
        return urls

    def merge(self, most: int = 8) -> None:
        """Long crawls: parts beyond ``most`` become one, so that a round does not meet ever more of them."""
        if len(self.parts) > most:
            every = reliable_checkpoint(reduce(DataFrame.unionByName, self.parts))
            old, self.parts = self.parts, []
            self.add(every)
            for part in old:
                part.unpersist()

    def close(self) -> None:
        for part in self.parts:
            part.unpersist()


def crawl(
    seeds: DataFrame,
    links: DataFrame,
    max_depth: int,
    cap: int | None = None,
    rows_per_key: int = ROWS_PER_KEY,
    partitions: int | None = None,
    overflow: str = "drop",
    max_rounds: int | None = None,
) -> DataFrame:
    """All URLs reached from ``seeds`` (``url, depth``) over ``links`` (``src_url, url``), with their smallest
    depth, depths 0 to ``max_depth``.

    With ``cap`` a round takes that many URLs at most. ``overflow`` says what becomes of the others: ``drop`` leaves them
    unvisited, and they may be found again; ``keep`` puts them into a backlog that the next rounds take first, by depth
    and URL, until it is empty or ``max_rounds`` have run. With enough rounds the result is that without a cap.

    The link table is checkpointed and kept spread by source, and the URLs found are kept by URL, so every round
    shuffles only the frontier and what it finds (parts lost with an executor are read back from the checkpoint). Each
    round's result is checkpointed, so the lineage stays one round long.
    """
    if overflow not in ("drop", "keep"):
        raise ValueError(f"overflow is {overflow!r}, not drop or keep")
    spark = seeds.sparkSession
    edges = reliable_checkpoint(links.select("src_url", "url"))
    # at most rows_per_key rows per part, whatever the session's default is
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges.count() // rows_per_key))
    heavy = reliable_checkpoint(heavy_keys(edges, ["src_url"], rows_per_key))
    edges = salt_big(edges, heavy, ["src_url"]).repartition(n, "src_url", "_salt").persist()
    edges.count()  # the joins below see the partitioning only once the table is there

    seen = _Seen(n)
    frontier = reliable_checkpoint(seeds.groupBy("url").agg(F.min("depth").alias("depth")))
    seen.add(frontier)
    if cap is not None and overflow == "keep":
        rounds = _backlog_rounds(edges, heavy, seen, frontier, max_depth, cap, max_rounds, rows_per_key)
    else:
        rounds = [frontier]
        for depth in range(max_depth if max_rounds is None else min(max_depth, max_rounds)):
            fresh = _next_round(edges, heavy, seen, rounds[-1]).withColumn("depth", F.lit(depth + 1))
            if cap is not None:
                fresh = frontier_limit(fresh, cap)
            fresh = reliable_checkpoint(fresh)
            if fresh.isEmpty():
                break
            rounds.append(fresh)
            seen.add(fresh)
    edges.unpersist()
    seen.close()
    return reduce(DataFrame.unionByName, rounds)


def _next_round(edges: DataFrame, heavy: DataFrame, seen: _Seen, frontier: DataFrame) -> DataFrame:
    sources = salt_small(frontier.select(F.col("url").alias("src_url")), heavy, ["src_url"])
    return seen.new(edges.join(sources, ["src_url", "_salt"]).select("url"))


def _backlog_rounds(
    edges: DataFrame,
    heavy: DataFrame,
    seen: _Seen,
    pending: DataFrame,
    max_depth: int,
    cap: int,
    max_rounds: int | None,
    rows_per_key: int,
) -> list[DataFrame]:
    """Rounds over a backlog. A URL is seen as soon as it is pending; the shallowest are always taken first, so what a
    round finds is never shallower than what is pending, and every URL comes in at its smallest depth."""
    rounds: list[DataFrame] = []
    while not pending.isEmpty() and (max_rounds is None or len(rounds) < max_rounds):
        split = reliable_checkpoint(frontier_split(pending, cap, rows_per_key))
        taken, rest = split.filter("now").drop("now"), split.filter("NOT now").drop("now")
        rounds.append(taken)
        found = []
        sources = taken.filter(F.col("depth") < max_depth)
        for depth in sorted(r["depth"] for r in sources.select("depth").distinct().collect()):  # as many as there are depths
            fresh = _next_round(edges, heavy, seen, sources.filter(F.col("depth") == depth))
            fresh = reliable_checkpoint(fresh.withColumn("depth", F.lit(depth + 1)))
            if not fresh.isEmpty():
                seen.add(fresh)
                found.append(fresh)
        seen.merge()
        pending = reliable_checkpoint(reduce(DataFrame.unionByName, found, rest))
    return rounds or [pending]


def numbered_by_group(df: DataFrame, group: str, order: list[str], rows_per_group: int = ROWS_PER_KEY) -> DataFrame:
    """Exact ``_rn`` = 1, 2, … per group in the given order.

    While no group is larger than ``rows_per_group`` this is a plain window. Otherwise a group's rows are
    range-partitioned in order over many tasks, numbered inside each partition, and shifted by the number of
    rows the group has in earlier partitions.
    """
    largest = df.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    if largest <= rows_per_group:
        return df.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    total = df.count()
    parts = max(2, -(-total // rows_per_group))
    ranged = df.repartitionByRange(parts, group, *order).withColumn("_part", F.spark_partition_id())
    ranged = reliable_checkpoint(ranged)  # the bounds are sampled: fix the assignment before using it twice
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(group, "_part")
        .count()
        .withColumn("_offset", F.coalesce(F.sum("count").over(before), F.lit(0)))
        .drop("count")
    )
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return (
        ranged.withColumn("_local", inside)
        .join(offsets, [group, "_part"])
        .withColumn("_rn", (F.col("_local") + F.col("_offset")).cast("int" if total < 2**31 else "long"))
        .drop("_local", "_offset", "_part")
    )


def fetch_plan(frontier: DataFrame, delay_ms: int, rows_per_group: int = ROWS_PER_KEY) -> DataFrame:
    """Per-host timetable of a frontier: one fetch every ``delay_ms``, in order of depth and URL."""
    tagged = frontier.select(url_host(F.col("url")).alias("host"), "depth", "url")
    numbered = numbered_by_group(tagged, "host", ["depth", "url"], rows_per_group)
    slot = ((F.col("_rn") - 1) * F.lit(delay_ms).cast("long")).alias("slot_ms")
    return numbered.select("host", "depth", "url", F.col("_rn").cast("long").alias("position"), slot)
