"""A table that grows by whole batches: writing a batch again, after success or after a crash, leaves its rows once."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType([T.StructField("batch", T.LongType()), T.StructField("attempt", T.StringType())])


class BatchTable:
    """Parquet files under ``path``: every attempt to write a batch has a folder of its own under ``data``, and the
    manifest names the attempt that counts. The manifest entry is written last, so a batch is there whole or not at
    all; nothing is renamed, so any store will do. Columns of the table are those of ``schema``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def committed(self, batches: Iterable[int] | None = None) -> dict[int, str]:
        """The attempt that counts for every batch written (one row per batch)."""
        entries = self._read(f"{self.path}/manifest", MANIFEST)
        if batches is not None:
            entries = entries.filter(F.col("batch").isin(list(batches)))
        return {r["batch"]: r["attempt"] for r in entries.collect()}

    def write(self, rows: DataFrame, batch: int, again: bool = False) -> DataFrame:
        """Write ``rows`` as ``batch`` unless it is there, and return them as stored. With ``again`` the rows are always
        computed and replace those of an earlier attempt; a batch of a stream with state needs that."""
        want = [(f.name, f.dataType.simpleString()) for f in self.schema]
        have = [(f.name, f.dataType.simpleString()) for f in rows.schema]
        if want != have:
            raise ValueError(f"columns differ: {sorted(set(want) ^ set(have))}")
        if again or batch not in self.committed([batch]):
            attempt = uuid.uuid4().hex
            rows.write.parquet(f"{self.path}/data/batch={batch}/attempt={attempt}")
            entry = self.spark.createDataFrame([(batch, attempt)], MANIFEST).coalesce(1)
            entry.write.mode("overwrite").parquet(f"{self.path}/manifest/entry={batch}")
        return self.read([batch])

    def read(self, batches: Iterable[int] | None = None) -> DataFrame:
        """Rows of the committed batches (all, or those named) with their ``batch``."""
        schema = T.StructType([*self.schema, T.StructField("batch", T.LongType())])
        folders = [f"{self.path}/data/batch={b}/attempt={a}" for b, a in self.committed(batches).items()]
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema).option("basePath", f"{self.path}/data")
        return reader.parquet(*folders).select(*schema.names)

    def stream(self) -> DataFrame:
        """Rows as they are written, with their ``batch``. Rows of an attempt that was given up may come as well, so the
        reader must not mind a row twice."""
        schema = T.StructType([*self.schema, T.StructField("batch", T.LongType())])
        return self.spark.readStream.schema(schema).parquet(f"{self.path}/data").select(*schema.names)

    def next_batch(self) -> int:
        return max(self.committed(), default=-1) + 1

    def _read(self, path: str, schema: T.StructType) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
