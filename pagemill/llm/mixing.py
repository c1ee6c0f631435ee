"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / size of the source. Documents stand in
order of size inside their source, expected copies are added up from the first, one offset per source is added,
and a document is taken once for every whole number its interval crosses.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import ordered_rank, saved, with_row
from pagemill.operators.joins import lookup_join, shared_folder

WEIGHTS = (1.0, 2.0, 3.0)  # for sources by code point, repeating
SHARE = 1.0  # of all sizes that the targets share
LIMIT = 3.0  # targets stop at this many times the size of their source
SEED = 7
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words, runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(
    sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, limit: float = LIMIT
) -> DataFrame:
    """``sources`` (``source, source_size, ...``, one row each) with ``target`` added.

    Sources in code point order, null last, take the weights in turn. Targets are weight times one level, but never
    over ``limit`` times the size; the level is raised until they share ``share`` of all sizes, or all stand at
    their limit. Each round is one aggregation over the sources, whose sums alone reach the driver.
    """
    most = F.col("source_size") * F.lit(float(limit))
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    order = [F.col("source").asc_nulls_last()]
    listed = saved(ordered_rank(sources, order, "_at").withColumn("_weight", each).drop("_at"))
    total = listed.agg(F.sum("source_size")).first()[0] or 0
    level, limited = 0.0, -1
    while True:
        over = most <= F.col("_weight") * F.lit(level)
        row = listed.agg(
            F.sum(F.when(over, most)).alias("full"),
            F.sum(F.when(~over, F.col("_weight"))).alias("free"),
            F.count(F.when(over, 1)).alias("limited"),
        ).first()
        if not row["free"] or row["limited"] == limited:
            break
        limited = row["limited"]
        level = max(level, (total * share - (row["full"] or 0.0)) / row["free"])
    reached = F.least(most, F.col("_weight") * F.lit(level))
    return listed.withColumn("target", reached.cast("double")).drop("_weight")


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` (``source``, ``size`` in words and any others) with ``source_size, target, copies, taken``.

    Returns every row, also those with no copy. A null source is a source of its own; a null size is 0, and a source
    whose sizes are all 0 has target 0 and no copies. The same rows in the same files give the same mixture. Columns
    of ``docs`` with the added names are replaced. No task sees a whole source: places come from a global rank.
    """
    added = ("source_size", "target", "copies", "taken")
    docs = docs.drop(*added).withColumn("size", F.coalesce(F.col("size").cast("long"), F.lit(0).cast("long")))
    tie = [F.col(n) for n in docs.columns if n == "doc_id"] + [F.monotonically_increasing_id()]
    rows = docs.withColumn("_tie", tie[-1])
    order = [F.col("source").asc_nulls_last(), F.col("size"), *tie[:-1], F.col("_tie")]
    ranked = ordered_rank(rows, order)
    stats = saved(ranked.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.min("_rank").alias("_first")))
    goals = saved(targets(stats, weights, share, limit).select(
        F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"),
        "source_size", "target", "_first"))
    keyed = ranked.withColumn("_source", F.coalesce("source", F.lit(""))).withColumn("_none", F.col("source").isNull())
    joined = lookup_join(keyed, goals, ["_source", "_none"], "inner", materialized=True)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.pmod(F.xxhash64("_source", "_none", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    place = F.col("_rank") - F.col("_first")
    upto = lambda n: F.floor(n * ratio + offset)
    copies = F.least(upto(place + 1) - upto(place), F.lit(int(-(-limit // 1)))).cast("long")
    return (
        joined.withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*docs.columns, *added)
    )


def mix_documents(docs: DataFrame, folder: str | None = None, **settings) -> DataFrame:
    """The mixture of whole documents: every row of ``docs`` as often as it is taken, with the columns of ``docs``.

    Documents are written once into ``folder``, a new one in the shared folder if none is given, with a number for every
    row; the result reads it, so it can be removed when the result is written. Only numbers, sources and sizes are
    ranked; the texts then meet their copies by row number, which spreads long documents evenly.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/mixed-{uuid.uuid4().hex}"
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("doc")
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), word_count(F.col("text")).alias("size"), whole)
    numbered.write.parquet(folder)
    rows = spark.read.schema(numbered.schema).parquet(folder)
    taken = mix(rows.select("row", "size", F.col("doc.source").alias("source"), F.col("doc.doc_id").alias("doc_id")), **settings)
    taken = taken.filter("copies > 0").select("row", "copies")
    repeated = rows.join(taken, "row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col(f"doc.`{n}`").alias(n) for n in docs.columns])


def document_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of every document, saved, so that the texts are read once."""
    return with_row(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))).drop("_row")
