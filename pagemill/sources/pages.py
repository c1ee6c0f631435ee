"""Captured pages as input: reading, status filter, seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.schema import FRONTIER_SCHEMA, PAGE_SCHEMA


def read_pages(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None, **options
) -> DataFrame:
    """Captured pages. The body is kept verbatim.

    ``fmt`` is ``parquet``, ``orc``, ``json`` or ``csv``; or ``html`` for a folder of page files, whose paths
    become the URLs. JSON and CSV need a schema, `PAGE_SCHEMA` by default, so that no inference pass is run.
    """
    if fmt == "html":
        files = spark.read.format("binaryFile").options(**{"recursiveFileLookup": "true", **options}).load(path)
        return files.select(
            F.col("path").alias("url"),
            F.lit(200).alias("status"),
            F.col("content").cast("string").alias("html"),
            F.col("modificationTime").alias("fetched_at"),
        )
    reader = spark.read.format(fmt)
    if fmt in ("json", "csv"):
        schema = schema or PAGE_SCHEMA
    if fmt == "csv":
        # page bodies hold line breaks and quotes
        options = {"header": "true", "multiLine": "true", "quote": '"', "escape": '"', **options}
    if schema is not None:
        reader = reader.schema(schema)
    return reader.options(**options).load(path)


def spread(pages: DataFrame) -> DataFrame:
    """Spread a table that comes in fewer splits than there are cores (a small file is one split) before it is
    parsed. A table with enough splits is left alone: nothing is shuffled."""
    cores = pages.sparkSession.sparkContext.defaultParallelism
    return pages if pages.rdd.getNumPartitions() >= cores else pages.repartition(cores)


def ok_responses(pages: DataFrame) -> DataFrame:
    """Responses with status 200; the filter reaches the scan."""
    return pages.filter(F.col("status") == 200)


def seed_frontier(seeds: DataFrame | Sequence[str], spark: SparkSession | None = None) -> DataFrame:
    """Seeds at depth 0, each once, neither filtered nor normalised."""
    if isinstance(seeds, DataFrame):
        urls = seeds.select("url")
    else:
        spark = spark or SparkSession.active()
        urls = spark.createDataFrame([(u,) for u in seeds], "url string")
    return urls.distinct().select("url", F.lit(0).cast(FRONTIER_SCHEMA["depth"].dataType).alias("depth"))
