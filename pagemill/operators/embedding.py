"""Vectors for a table of texts, each different text embedded once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import content_hash
from pagemill.operators.joins import BROADCAST_BYTES, PAGE_ROWS_PER_KEY, lookup_join, reliable_checkpoint

PART_BYTES = 64 << 20  # of texts in one task


def embed_once(
    rows: DataFrame,
    embed: Callable[[Column], Column],
    text: str = "text",
    vector: str = "content_vector",
    part_bytes: int = PART_BYTES,
    max_bytes: int = BROADCAST_BYTES,
    rows_per_key: int = PAGE_ROWS_PER_KEY,
) -> DataFrame:
    """``rows`` with ``vector``: what ``embed`` gives for ``text``, computed once per different text.

    Texts are told apart by their content hash; copies are dropped with partial aggregation on the hash. The different
    ones are dealt by length into tasks of about ``part_bytes`` and sorted by it there, so that a batch of the model holds
    texts of like length. The vectors are saved and joined back by the hash, which moves no text while they measure little,
    and splits hot hashes beyond that. A null text is embedded like any other. A column named as ``vector`` is replaced.
    """
    kept = [c for c in rows.columns if c != vector]
    key = F.coalesce(content_hash(F.col(text)), F.lit(""))
    tagged = rows.select(*[F.col(f"`{c}`") for c in kept], key.alias("_hash"))
    different = tagged.select("_hash", F.col(f"`{text}`").alias("_text")).dropDuplicates(["_hash"])
    size = F.coalesce(F.octet_length("_text"), F.lit(0))
    different = reliable_checkpoint(different)
    total = different.agg(F.sum(size.cast("long"))).first()[0] or 0
    dealt = different.withColumn("_size", size).repartitionByRange(max(1, -(-total // part_bytes)), "_size", "_hash")
    vectors = dealt.sortWithinPartitions("_size").select("_hash", embed(F.col("_text")).alias(vector))
    joined = lookup_join(tagged, vectors, ["_hash"], "left", max_bytes, rows_per_key)
    return joined.select(*[F.col(f"`{c}`") for c in kept], vector)
