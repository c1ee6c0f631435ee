"""The same operators on a stream of captured pages."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pagemill.operators.dedup import dedup_documents
from pagemill.operators.joins import lookup_join, reliable_checkpoint
from pagemill.operators.validate import report_of_counts
from pagemill.plans.documents import to_documents
from pagemill.schema import PAGE_SCHEMA
from pagemill.sources.batches import BatchTable
from pagemill.streaming.state import run_batches, with_rocksdb


def stream_pages(
    spark: SparkSession,
    path: str,
    schema: T.StructType = PAGE_SCHEMA,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
    **options,
) -> DataFrame:
    """Pages as they arrive in a folder. ``max_files_per_trigger`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def stream_documents(
    pages: DataFrame,
    content_tags: Sequence[str] = (),
    embed: Callable[[Column], Column] | None = None,
    dimension: int | None = None,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Documents of a page stream: the batch operators unchanged, map-only, no state. Pages without status 200
    are left out."""
    usable = pages.filter(F.col("status") == 200) if "status" in pages.columns else pages
    return to_documents(usable, content_tags, embed, dimension, extra)


def stream_dedup(
    rows: DataFrame, key: str, event_time: str | None = None, delay: str | None = None, spread: int = 16
) -> DataFrame:
    """The first row per ``key``.

    With ``event_time`` and ``delay`` the state is bounded: repeats that come within the delay are dropped, and so is
    every row later than the delay, first of its key or not, because Spark lets none behind the watermark
    (`stream_dedup_late` keeps those). Without them every key ever seen is remembered, in RocksDB (see `run_available`).
    Rows are first reduced per (key, input partition modulo ``spread``), so copies of one hot key are dropped on many
    tasks and at most ``spread`` of them reach the task that decides.
    """
    salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(spread)))
    if event_time is None:
        return salted.dropDuplicates([key, "_salt"]).drop("_salt").dropDuplicates([key])
    timed = salted.withWatermark(event_time, delay)
    return timed.dropDuplicatesWithinWatermark([key, "_salt"]).drop("_salt").dropDuplicatesWithinWatermark([key])


def stream_dedup_urls(
    pages: DataFrame, delay: str | None = None, event_time: str = "fetched_at", spread: int = 16
) -> DataFrame:
    """Visited test on a stream: each URL passes once (within ``delay`` of event time when given)."""
    return stream_dedup(pages, "url", event_time if delay else None, delay, spread)


def run_available(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append what is there now to the Parquet table at ``path`` and wait; exactly once across restarts. State is kept
    in RocksDB, so it may outgrow the memory of an executor."""
    with with_rocksdb(stream.sparkSession):
        return _run_available(stream, path, checkpoint, partition_by)


def _run_available(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str]) -> StreamingQuery:
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    query = writer.trigger(availableNow=True).start(path)
    query.awaitTermination()
    return query


def stream_dedup_late(
    rows: DataFrame, root: str, key: str, event_time: str, delay: str, spread: int = 16
) -> tuple[DataFrame, DataFrame]:
    """`stream_dedup` with bounded state that loses no key: (passed, late), read from tables under ``root``.

    Rows land first, each marked late or not: late is what lies more than ``delay`` behind the newest event time of all
    earlier batches, or has none. The others pass through the bounded dedup; its watermark is never ahead of that mark,
    so it drops none of them. Late rows are the side table. A late row whose key has passed is a repeat; of the
    others the first per key, by event time, is returned. What has passed is shuffled only where the late keys are too
    many to broadcast. Only what there is in ``rows`` is written, so pass narrow columns.
    """
    spark = rows.sparkSession
    arrived = BatchTable(spark, f"{root}/arrived", T.StructType([*rows.schema, T.StructField("_late", T.BooleanType())]))
    clock = BatchTable(spark, f"{root}/clock", T.StructType([T.StructField("newest", rows.schema[event_time].dataType)]))

    def land(batch: DataFrame, number: int) -> None:
        before = clock.read([number - 1]).first()
        newest = F.lit(before["newest"] if before else None).cast(rows.schema[event_time].dataType)
        behind = F.col(event_time) <= newest - F.expr(f"INTERVAL {delay}")
        late = F.col(event_time).isNull() | F.coalesce(behind, F.lit(False))
        stored = arrived.write(batch.withColumn("_late", late), number)
        clock.write(stored.agg(F.greatest(F.max(event_time), newest).alias("newest")), number)

    run_batches(rows, land, f"{root}/_progress/arrived")
    if not arrived.committed():
        return spark.createDataFrame([], rows.schema), spark.createDataFrame([], rows.schema)
    on_time = arrived.stream().filter("NOT _late").select(*rows.columns)
    run_available(stream_dedup(on_time, key, event_time, delay, spread), f"{root}/passed", f"{root}/_progress/passed")
    passed = spark.read.schema(rows.schema).parquet(f"{root}/passed")

    firsts = dedup_documents(arrived.read().filter("_late").select(*rows.columns), key, [event_time])
    firsts = reliable_checkpoint(firsts)
    known = lookup_join(passed.select(key), firsts.select(key).distinct(), [key], "left_semi").distinct()
    return passed, lookup_join(firsts, known, [key], "left_anti")


def stream_late_urls(pages: DataFrame, root: str, delay: str, event_time: str = "fetched_at") -> tuple[DataFrame, DataFrame]:
    """Visited test on a stream with bounded state: (URLs that passed, late URLs that had not passed before)."""
    return stream_dedup_late(pages.select("url", event_time), root, "url", event_time, delay)


def stream_crawl_report(outcomes: DataFrame, root: str) -> DataFrame:
    """The report of `crawl_report` over a stream of ``depth, outcome``, kept up to date by a streaming aggregate: a batch
    writes the counts it changes, and the last count of every depth and outcome makes the report."""
    counted = outcomes.groupBy("depth", "outcome").agg(F.count(F.lit(1)).alias("n"))
    table = BatchTable(outcomes.sparkSession, f"{root}/counts", counted.schema)
    run_batches(counted, lambda batch, number: table.write(batch, number, again=True), f"{root}/_progress/counts", "update")
    return report_of_counts(table.read().groupBy("depth", "outcome").agg(F.max_by("n", "batch").alias("n")))
