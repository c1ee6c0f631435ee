"""Document table sink."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.operators.validate import document_reject_reason, vector_fits, zero_filled
from pagemill.schema import DOCUMENT_SCHEMA
from pagemill.sources.batches import BatchTable

ROUTED_SCHEMA = T.StructType([*DOCUMENT_SCHEMA, T.StructField("reject_reason", T.StringType())])


def assert_document_schema(documents: DataFrame) -> None:
    """Every write checks names and types, in order; nullability is not part of the contract."""
    want = [(f.name, f.dataType.simpleString()) for f in DOCUMENT_SCHEMA]
    have = [(f.name, f.dataType.simpleString()) for f in documents.schema]
    if want != have:
        raise ValueError(f"document columns differ: {sorted(set(want) ^ set(have))}")


def write_documents(documents: DataFrame, path: str, mode: str = "append", dimension: int | None = None) -> DataFrame:
    """Append documents to the table at ``path`` and return the table.

    Rows are added as they are: the same ``hash_id`` written twice is there twice (see `dedup_documents`). With
    ``dimension`` an absent or empty vector becomes zeros and one of another size fails the write; `write_routed` sets
    such rows aside instead.
    """
    assert_document_schema(documents)
    if dimension is not None:
        vector = F.col("content_vector")
        wrong = F.raise_error(F.concat(F.lit(f"vector size is not {dimension}: "), F.size(vector).cast("string")))
        checked = F.when(vector_fits(vector, dimension), zero_filled(vector, dimension)).otherwise(wrong)
        documents = documents.withColumn("content_vector", checked.cast("array<float>"))
    documents.write.mode(mode).parquet(path)
    return read_documents(documents.sparkSession, path)


def write_routed(
    documents: DataFrame,
    path: str,
    limits: Mapping[str, int] | None = None,
    dimension: int | None = None,
    mode: str = "append",
) -> tuple[DataFrame, DataFrame]:
    """Write documents that fit and those that do not in one pass over ``documents``: (accepted, rejected).

    Both are partitions of the table at ``path``. A document whose vector has another size than ``dimension``, or with a
    column over its limit, is rejected with its reason; accepted ones have absent vectors filled with zeros.
    """
    assert_document_schema(documents)
    reason = document_reject_reason(limits, dimension)
    routed = documents.withColumn("reject_reason", reason).withColumn("accepted", F.col("reject_reason").isNull())
    if dimension is not None:
        vector = F.col("content_vector")
        filled = F.when(F.col("accepted"), zero_filled(vector, dimension)).otherwise(vector)
        routed = routed.withColumn("content_vector", filled.cast("array<float>"))
    routed.write.mode(mode).partitionBy("accepted").parquet(path)
    stored = documents.sparkSession.read.schema(
        T.StructType([*ROUTED_SCHEMA, T.StructField("accepted", T.BooleanType())])
    ).parquet(path)
    accepted = stored.filter("accepted").drop("accepted", "reject_reason")
    return accepted, stored.filter("NOT accepted").drop("accepted")


def write_documents_once(documents: DataFrame, path: str, batch: int) -> DataFrame:
    """Add ``documents`` to the batch table at ``path`` under a number and return the table. A write that was killed, or is
    run again, leaves each row once: a batch that is there is not written again."""
    assert_document_schema(documents)
    table = BatchTable(documents.sparkSession, path, DOCUMENT_SCHEMA)
    table.write(documents, batch)
    return table.read().select(*DOCUMENT_SCHEMA.names)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT_SCHEMA).parquet(path)
