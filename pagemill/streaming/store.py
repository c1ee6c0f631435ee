"""The document store of a page stream: one document per content hash, the same that `dedup_documents` keeps."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.joins import PAGE_ROWS_PER_KEY, lookup_join, reliable_checkpoint
from pagemill.operators.robots import robots_allowed
from pagemill.plans.documents import documents_with_outcome
from pagemill.schema import DOCUMENT_SCHEMA
from pagemill.sources.batches import BatchTable
from pagemill.streaming.state import first_of_key, run_batches

ROW = T.StructField("row", T.LongType())
PLACE = [T.StructField("batch", T.LongType()), ROW]
LANDING_SCHEMA = T.StructType([*DOCUMENT_SCHEMA, T.StructField("reject_reason", T.StringType()), ROW])


def _first_in_batch(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row per key of one batch, with partial aggregation: a hot key is one row before it meets the state."""
    rest = [c for c in rows.columns if c != key]
    first = F.struct(*[F.col(c) for c in [*order, "row"]], *[F.col(c).alias(f"_{c}") for c in rest])
    kept = rows.groupBy(key).agg(F.min(first).alias("_first"))
    return kept.select(*[F.col(c) if c == key else F.col(f"_first._{c}").alias(c) for c in rows.columns])


def stream_store_documents(
    pages: DataFrame,
    root: str,
    content_tags: Sequence[str] = (),
    limits: Mapping[str, int] | None = None,
    embed: Callable[[Column], Column] | None = None,
    dimension: int | None = None,
    order: Sequence[str] = ("url",),
    robots: DataFrame | None = None,
    visited: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Store what a page stream holds now: (documents, rejects), both read from tables under ``root``.

    One document per ``hash_id``, the first by ``order`` (document columns; ties go to the row that came first) of all
    that ever came, so the store equals `dedup_documents` of the documents, however they are cut into batches. A stored
    document that a later batch outranks is replaced. With ``robots`` (the table of `robots_rules`) disallowed pages are
    rejected. With ``visited`` a URL counts once: of its captures in the batch that brings it first, the earliest by
    ``crawled_at``; later ones are neither documents nor rejects.

    * Landing is map-only: pages are parsed once and written with their outcome.
    * What goes on is narrow: hash, order and place of a document, already reduced to one row per key and batch. The
      state holds one such row per key and gives out changes only.
    * Bodies are attached once, when a document becomes the first of its hash, from the landed batch it is in. A
      replaced document is taken out by its place when the table is read.

    A batch that runs again after a crash is written under its number again, so nothing is there twice. Calling this
    again goes on with what has come since.
    """
    spark = pages.sparkSession
    types = {f.name: f for f in DOCUMENT_SCHEMA}
    narrow = T.StructType([types["hash_id"], *[types[c] for c in dict.fromkeys(["url", "crawled_at", *order])], ROW])
    landing = BatchTable(spark, f"{root}/landing", LANDING_SCHEMA)
    candidates = BatchTable(spark, f"{root}/candidates", narrow)
    passed = BatchTable(spark, f"{root}/passed", T.StructType([*narrow, T.StructField("landed", T.LongType())]))
    changes = BatchTable(spark, f"{root}/changes", T.StructType(
        [types["hash_id"], ROW, T.StructField("landed", T.LongType()), T.StructField("old_row", T.LongType()), T.StructField("old_landed", T.LongType())]
    ))
    stored = BatchTable(spark, f"{root}/documents", T.StructType([*DOCUMENT_SCHEMA, ROW, T.StructField("landed", T.LongType())]))

    def land(batch: DataFrame, number: int) -> None:
        if number not in landing.committed([number]):
            gated = batch if robots is None else robots_allowed(batch, robots)
            routed = documents_with_outcome(gated, content_tags, limits, embed, dimension)
            landing.write(routed.withColumn("row", F.monotonically_increasing_id()), number)
        good = landing.read([number]).filter(F.col("reject_reason").isNull()).select(*narrow.names)
        one = _first_in_batch(good, "url", ["crawled_at"]) if visited else _first_in_batch(good, "hash_id", order)
        candidates.write(one, number)

    def pass_on(batch: DataFrame, number: int) -> None:
        rows = batch.select(*narrow.names, F.col("batch").alias("landed"))
        # several landed batches may come in one: the earlier one decides between equal documents
        passed.write(_first_in_batch(rows, "hash_id", [*order, "landed"]), number, again=True)

    def store(batch: DataFrame, number: int) -> None:
        found = changes.write(batch.select(*changes.schema.names), number, again=True)
        landed = [r["landed"] for r in found.select("landed").distinct().collect()]  # batches, not rows
        bodies = landing.read(landed).withColumnRenamed("batch", "landed")
        place = found.select("landed", "row")
        attached = lookup_join(bodies, place, ["landed", "row"], "inner", rows_per_key=PAGE_ROWS_PER_KEY, materialized=True)
        stored.write(attached.select(*stored.schema.names), number)

    run_batches(pages, land, f"{root}/_progress/landing")
    if landing.committed():
        source, landed = candidates, "batch"
        if visited:
            new = first_of_key(candidates.stream(), "url", ["batch", "crawled_at"], once=True)
            run_batches(new, pass_on, f"{root}/_progress/visited", "update")
            source, landed = passed, "landed"
        rows = source.stream().select("hash_id", *[c for c in dict.fromkeys(order)], F.col(landed).alias("batch"), "row")
        firsts = first_of_key(rows, "hash_id", order)
        firsts = firsts.withColumnsRenamed({"batch": "landed", "old_batch": "old_landed"})
        run_batches(firsts, store, f"{root}/_progress/documents", "update")
    return stored_documents(stored, changes), landing.read().filter(F.col("reject_reason").isNotNull()).select("url", "reject_reason")


def stored_documents(stored: BatchTable, changes: BatchTable) -> DataFrame:
    """The documents that no later one has replaced. Replaced ones are few and known by place, so no body is shuffled
    while their table is small."""
    old = changes.read().filter(F.col("old_row").isNotNull())
    old = reliable_checkpoint(old.select(F.col("old_landed").alias("landed"), F.col("old_row").alias("row")))
    kept = lookup_join(stored.read(), old, ["landed", "row"], "left_anti", rows_per_key=PAGE_ROWS_PER_KEY, materialized=True)
    return kept.select(*DOCUMENT_SCHEMA.names)
