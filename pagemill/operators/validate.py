"""Row checks, reject routing, outcome report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagemill.functions.urls import is_valid_url
from pagemill.schema import EMBEDDING_DIMENSION


def length_violation(limits: Mapping[str, int]) -> Column:
    """Name of the first column longer than its limit, else NULL. Limits are bytes; 0 means none."""
    out = F.lit(None).cast("string")
    for column, limit in reversed([(c, n) for c, n in limits.items() if n > 0]):
        out = F.when(F.octet_length(F.col(column)) > limit, F.lit(column)).otherwise(out)
    return out


def check_lengths(documents: DataFrame, limits: Mapping[str, int]) -> DataFrame:
    """Adds ``too_long``: the first column over its limit, else NULL."""
    return documents.withColumn("too_long", length_violation(limits))


def vector_fits(vector: Column, dimension: int) -> Column:
    """True for an absent, empty or full-size vector."""
    return vector.isNull() | F.size(vector).isin(0, dimension)


def check_vector(documents: DataFrame, dimension: int = EMBEDDING_DIMENSION, vector: str = "content_vector") -> DataFrame:
    """Adds ``vector_ok``."""
    return documents.withColumn("vector_ok", vector_fits(F.col(vector), dimension))


def zero_filled(vector: Column, dimension: int) -> Column:
    empty = vector.isNull() | (F.size(vector) == 0)
    return F.when(empty, F.array_repeat(F.lit(0.0).cast("float"), dimension)).otherwise(vector)


def fill_zero_vector(documents: DataFrame, dimension: int = EMBEDDING_DIMENSION, vector: str = "content_vector") -> DataFrame:
    """An absent or empty vector becomes zeros of the configured size."""
    return documents.withColumn(vector, zero_filled(F.col(vector), dimension))


def page_reject_reason(url: Column, allowed: Column | None = None, status: Column | None = None) -> Column:
    """Why a page is dropped before it is parsed, in the order of the checks; NULL when it is not."""
    out = F.when(~is_valid_url(url), F.lit("bad_url"))
    if allowed is not None:
        out = out.when(~allowed, F.lit("robots"))
    if status is not None:
        out = out.when(F.coalesce(status, F.lit(0)) != 200, F.lit("status"))
    return out


def document_reject_reason(limits: Mapping[str, int] | None = None, dimension: int | None = None) -> Column:
    """Why a document is not stored: vector size first, then declared lengths; NULL when it is."""
    out = F.lit(None).cast("string")
    if limits:
        out = F.concat(F.lit("too_long:"), length_violation(limits))
    if dimension is not None:
        out = F.when(~vector_fits(F.col("content_vector"), dimension), F.lit("vector_size")).otherwise(out)
    return out


def route_rejects(tagged: DataFrame, reason: str = "reject_reason") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by a reason column. Both sides read ``tagged``: write it once, partitioned by
    outcome, when computing it is costly."""
    return tagged.filter(F.col(reason).isNull()).drop(reason), tagged.filter(F.col(reason).isNotNull())


def crawl_report(outcomes: DataFrame) -> DataFrame:
    """Pages per depth and outcome with totals: NULL depth or outcome stands for all (`depth_total`,
    `outcome_total` mark it)."""
    return report_of_counts(outcomes.withColumn("n", F.lit(1)))


def report_of_counts(counts: DataFrame) -> DataFrame:
    """The report from ``depth, outcome, n``."""
    return counts.rollup("depth", "outcome").agg(
        F.sum("n").cast("long").alias("pages"),
        F.grouping("depth").cast("int").alias("depth_total"),
        F.grouping("outcome").cast("int").alias("outcome_total"),
    )


def observed_report(
    rows: DataFrame, depths: Sequence[int | None], outcomes: Sequence[str | None], depth: str = "depth", outcome: str = "outcome"
) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """(rows to write, report): the report of `crawl_report`, counted by the job that writes the rows, without reading
    them again. ``depths`` and ``outcomes`` list what can occur (None for null); the report fails if anything else did, and
    waits until the rows have been written."""
    observation = Observation()
    cells = [(d, o) for d, o in product(dict.fromkeys(depths), dict.fromkeys(outcomes))]
    same = lambda c, v: F.col(c).isNull() if v is None else F.coalesce(F.col(c) == F.lit(v), F.lit(False))
    counts = [F.count(F.when(same(depth, d) & same(outcome, o), 1)).alias(f"c{k}") for k, (d, o) in enumerate(cells)]
    spark = rows.sparkSession
    kinds = [rows.schema[depth].dataType.simpleString(), rows.schema[outcome].dataType.simpleString()]

    def report() -> DataFrame:
        found = observation.get
        if sum(found[f"c{k}"] for k in range(len(cells))) != found["every"]:
            raise ValueError("rows with a depth or outcome that was not listed")
        table = [(d, o, found[f"c{k}"]) for k, (d, o) in enumerate(cells) if found[f"c{k}"]]
        return report_of_counts(spark.createDataFrame(table, f"depth {kinds[0]}, outcome {kinds[1]}, n long"))

    return rows.observe(observation, F.count(F.lit(1)).alias("every"), *counts), report
