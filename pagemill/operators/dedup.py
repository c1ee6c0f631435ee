"""Content keys: one document per hash, and the collisions made visible."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.joins import BROADCAST_BYTES, PAGE_ROWS_PER_KEY, ROWS_PER_KEY, lookup_join, reliable_checkpoint


def dedup_documents(
    documents: DataFrame,
    key: str = "hash_id",
    order: Sequence[str] = ("depth", "url"),
    max_bytes: int = BROADCAST_BYTES,
    rows_per_key: int = PAGE_ROWS_PER_KEY,
) -> DataFrame:
    """One row per key, the first by ``order``; rows without key all stay.

    The survivor of every key that occurs more than once is found on the narrow columns, with partial aggregation. The
    documents then lose the other rows by a checked join: while the table of repeated keys is small, no body is
    shuffled. Only rows that tie in every order column go through a window. ``documents`` is read twice, so pass a
    written table where it is costly.
    """
    missing = [c for c in order if c not in documents.columns]
    if missing or not order:
        raise ValueError(f"order columns are missing: {missing}")
    first = F.struct(*[F.col(c) for c in order])
    counted = documents.filter(F.col(key).isNotNull()).groupBy(key, first.alias("_first")).agg(F.count(F.lit(1)).alias("_n"))
    repeated = counted.groupBy(key).agg(F.sum("_n").alias("_all"), F.min(F.struct("_first", "_n")).alias("_kept"))
    repeated = reliable_checkpoint(
        repeated.filter("_all > 1").select(key, F.col("_kept._first").alias("_first"), F.col("_kept._n").alias("_ties"))
    )
    tagged = lookup_join(documents, repeated, [key], "left", max_bytes, rows_per_key, materialized=True)
    kept = tagged.filter(F.col("_first").isNull() | F.col("_first").eqNullSafe(first))
    if not repeated.filter("_ties > 1").isEmpty():
        tie = F.col("_ties") > 1
        w = Window.partitionBy(key).orderBy(*order)
        one = kept.filter(tie).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
        kept = kept.filter(tie.isNull() | ~tie).unionByName(one)
    return kept.select(*documents.columns)


def duplicate_groups(documents: DataFrame, key: str = "hash_id", member: str = "url") -> DataFrame:
    """Keys with more than one row: count, first and last member. Partial aggregation, nothing is collected."""
    m = F.col(member)
    return (
        documents.groupBy(key)
        .agg(F.count(F.lit(1)).alias("n"), F.min(m).alias("first_member"), F.max(m).alias("last_member"))
        .filter(F.col("n") > 1)
    )


def duplicate_members(
    documents: DataFrame,
    key: str = "hash_id",
    member: str = "url",
    max_bytes: int = BROADCAST_BYTES,
    rows_per_key: int = ROWS_PER_KEY,
) -> DataFrame:
    """The rows of the duplicate groups, one per member, with the member the group would keep. A group of any
    size stays spread out."""
    kept = duplicate_groups(documents, key, member).select(key, F.col("first_member").alias("kept_member"))
    return lookup_join(documents.select(key, member), kept, [key], "inner", max_bytes, rows_per_key)
