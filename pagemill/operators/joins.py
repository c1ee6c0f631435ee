"""Joins that hold up when one key has a large share of the rows, and a broadcast that is checked first."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 << 20
ROWS_PER_KEY = 2_000_000  # of narrow rows (URLs, hashes)
PAGE_ROWS_PER_KEY = 20_000  # of rows that carry a page body


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the one in ``spark.checkpoint.dir``, or the checkpoint folder already set.

    A private folder is made only for a ``local`` master, where driver and executors are one process; on a cluster
    without the setting this fails, because executors could not read each other's files.
    """
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="checkpoint-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def reliable_checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; a lost executor does not lose it. The files go when
    the frame is collected as garbage and ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def _row_bytes(df: DataFrame) -> Column:
    """Upper estimate of the bytes of one row from its values."""
    total = F.lit(16)
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType) and not isinstance(
            f.dataType.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)
        ):
            size = F.size(c) * 8
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(F.struct(c)))
        else:
            size = F.lit(8)
        total = total + F.coalesce(size, F.lit(0))
    return total.cast("long")


def measured_bytes(df: DataFrame) -> int:
    return df.agg(F.sum(_row_bytes(df)).alias("b")).first()["b"] or 0


def broadcast_checked(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame | None:
    """``df`` marked for broadcast if its rows measure at most ``max_bytes``, else None."""
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else None


def heavy_keys(df: DataFrame, on: Sequence[str], rows_per_key: int = ROWS_PER_KEY) -> DataFrame:
    """Keys with more than ``rows_per_key`` rows and how many parts they are split into. There are at most
    ``rows / rows_per_key`` of them, so the table stays small whatever the data is."""
    return (
        df.groupBy(*on)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_key)
        .select(*on, F.ceil(F.col("_n") / rows_per_key).cast("int").alias("_parts"))
    )


def salt_big(big: DataFrame, heavy: DataFrame, on: Sequence[str]) -> DataFrame:
    """Add ``_salt``: rows of a heavy key are spread over its parts, all others get 0. The input partition takes
    part in the hash, so that equal rows spread as well; a task that runs again gives the same salts."""
    plain = [f.name for f in big.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    spread = F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in plain]), F.col("_parts"))
    return (
        big.join(F.broadcast(heavy), list(on), "left")
        .withColumn("_salt", F.coalesce(spread.cast("int"), F.lit(0)))
        .drop("_parts")
    )


def salt_small(small: DataFrame, heavy: DataFrame, on: Sequence[str]) -> DataFrame:
    """Repeat the rows of heavy keys once per part."""
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    return (
        small.join(F.broadcast(heavy), list(on), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_parts")
    )


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_bytes: int = BROADCAST_BYTES,
    rows_per_key: int = ROWS_PER_KEY,
    materialized: bool = False,
) -> DataFrame:
    """Join ``big`` (any key may be hot) to ``small``.

    ``small`` is broadcast when it measures at most ``max_bytes``: no shuffle, so no skew. Beyond that both
    sides are shuffled by key, and keys with more than ``rows_per_key`` rows in ``big`` are split over parts.
    ``how`` is one of ``inner``, ``left``, ``left_semi``, ``left_anti``. ``small`` is computed once, into a
    checkpoint, unless it is ``materialized`` already; the keys of ``big`` are read twice in the second case. On a
    stream the second case is a plain shuffled join.
    """
    on = list(on)
    if not materialized:
        small = reliable_checkpoint(small)
    bounded = broadcast_checked(small, max_bytes)
    if bounded is not None:
        return big.join(bounded, on, how)
    if big.isStreaming:  # the keys of a stream cannot be counted ahead; a batch of it is small
        return big.join(small, on, how)
    heavy = reliable_checkpoint(heavy_keys(big, on, rows_per_key))
    return salt_big(big, heavy, on).join(salt_small(small, heavy, on), [*on, "_salt"], how).drop("_salt")
