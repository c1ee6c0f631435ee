"""What several operators of this package share: Arrow slices, saved tables, a global rank, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.joins import reliable_checkpoint, salt_big, salt_small

SLICE_ROWS = 256
SLICE_BYTES = 8 << 20


def slices(batches: Iterable, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator:
    """Arrow batches in pieces of at most ``rows`` rows and about ``size`` bytes, so that few texts are Python objects at
    once; a longer row is a piece by itself."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            todo = [batch.slice(start, rows)]
            while todo:
                piece = todo.pop()
                if piece.num_rows > 1 and piece.nbytes > size:
                    half = piece.num_rows // 2
                    todo += [piece.slice(half), piece.slice(0, half)]
                else:
                    yield piece


def plain_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, … by place, so that added columns meet none of them, and the new name of
    each. `toDF` with the old names brings them back."""
    names = {name: f"c{k}" for k, name in enumerate(df.columns)}
    return df.toDF(*names.values()), names


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared checkpoint folder; a lost executor does not lose it."""
    return reliable_checkpoint(df)


def with_row(df: DataFrame, name: str = "_row") -> DataFrame:
    """``df`` saved with a number of its own for every row, repeated rows included."""
    return saved(df.withColumn(name, F.monotonically_increasing_id()))


LOCAL_BITS = 33  # of monotonically_increasing_id: the place inside the partition


def ordered_rank(df: DataFrame, order: list, name: str = "_rank") -> DataFrame:
    """Add the global rank from 0 in ``order`` without one task that sees all rows.

    Rows are dealt by range and sorted inside their partition; the place inside the partition plus the sizes of the
    partitions before it is the rank. ``order`` must tell rows apart where many of them tie, or they share a task.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = saved(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", LOCAL_BITS)
    local = F.col("_place").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before, total = [], 0
    for row in sizes.orderBy("_part").collect():  # one row per partition, as many as there are tasks
        before.append((row["_part"], total))
        total += row["_n"]
    schema = T.StructType([T.StructField("_part", T.LongType()), T.StructField("_before", T.LongType())])
    starts = F.broadcast(spark.createDataFrame(before, schema))
    return (
        dealt.withColumn("_part", part)
        .join(starts, "_part")
        .withColumn(name, F.col("_before") + local)
        .drop("_part", "_before", "_place")
    )


HUB_ROWS = 100_000  # narrow rows of one node in a task


def _beside(rows: DataFrame, least: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """``rows (a, b)`` with the columns of ``least`` (one row per ``a``); the rows of ``hubs`` are split over several tasks."""
    if hubs is None:
        return rows.join(least, "a")
    return salt_big(rows, hubs, ["a"]).join(salt_small(least, hubs, ["a"]), ["a", "_salt"]).drop("_salt")


def _hubs(rows: DataFrame, most: int) -> DataFrame | None:
    """Nodes with more than ``most`` rows and their ``_parts``; at most rows / ``most`` of them, and None without any."""
    many = rows.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    found = many.select("a", F.ceil(F.col("_n") / most).cast("int").alias("_parts"))
    listed = found.collect()
    return rows.sparkSession.createDataFrame(listed, found.schema) if listed else None


def connected_components(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph: one row ``(node, root)`` per node of an edge, root its smallest node.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type; null ends are left out, and a node that only
    meets itself is its own root. Rounds of large-star and small-star: each hangs neighbours on smaller nodes, so the
    number of edges never grows and about log(n) rounds end it. Every round is saved; nothing but two sums and
    the hubs reach the driver. The edges of a hub are dealt over several tasks.
    """
    spark = edges.sparkSession
    edges = edges.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    every = saved(edges.select(high, low).distinct())
    stars = every.filter("a != b")
    mark = _mark(stars)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    while mark[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hubs = _hubs(both, max(1, min(HUB_ROWS, max(1000, 2 * mark[0] // parts))))
        least = both.groupBy("a").agg(F.min("b").alias("_m"))
        large = _beside(both, least.select("a", F.least("a", "_m").alias("_m")), hubs).filter("b > a")
        large = large.select(F.col("b").alias("a"), F.col("_m").alias("b")).distinct()
        below = large.groupBy("a").agg(F.min("b").alias("_m"))
        # a node has no more rows here than it has neighbours, so the hubs are the same
        small = _beside(large, below, hubs).select("b", "_m").union(below.select("a", "_m")).toDF("a", "b")
        stars = saved(small.filter("a != b").distinct())
        now = _mark(stars)
        if now == mark:
            break
        mark = now
    alone = every.filter("a = b").select("a", "b")
    roots = stars.select("a", "b").union(stars.select("b", "b")).union(alone)
    return roots.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free sum of hashes: equal when a round changed nothing."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
