"""Keyed state of the streaming operators: narrow rows only, never a page or a document."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class with_rocksdb:
    """State may outgrow the memory of an executor, so it is kept in RocksDB while this holds."""

    def __init__(self, spark):
        self.conf = spark.conf

    def __enter__(self):
        self.before = self.conf.get(PROVIDER, None)
        self.conf.set(PROVIDER, ROCKSDB)

    def __exit__(self, *_):
        self.conf.unset(PROVIDER) if self.before is None else self.conf.set(PROVIDER, self.before)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand what is there now to ``each`` in micro-batches and wait. After a crash the last one comes again under its
    number."""
    with with_rocksdb(stream.sparkSession):
        query = (
            stream.writeStream.foreachBatch(each)
            .outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        return query


def ordered(values: Sequence) -> tuple:
    """Sort key with nulls first, as Spark sorts."""
    return tuple((v is not None, v) for v in values)


class FirstOfKey(StatefulProcessor):
    """Keeps the smallest row of a key by ``order``. A row comes out whenever that changes: the new one, with the
    place (``batch``, ``row``) of the one it replaces. With ``once`` the first batch of a key decides for good."""

    def __init__(self, key: str, fields: list[T.StructField], order: Sequence[str], once: bool):
        self.key, self.names, self.order, self.once = key, [f.name for f in fields], list(order), once
        self.held = T.StructType(fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("first", self.held)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        at = [self.names.index(n) for n in self.order]
        rank = lambda values: ordered([values[k] for k in at])
        before = tuple(self.state.get()) if self.state.exists() else None
        best = None if self.once else before
        for row in rows:
            values = tuple(row[n] for n in self.names)
            if best is None or rank(values) < rank(best):
                best = values
        if best is None or best == before or (self.once and before is not None):
            return
        self.state.update(best)
        old = dict(zip(self.names, before, strict=True)) if before else {}
        found = dict(zip(self.names, best, strict=True))
        yield Row(**{self.key: key[0], **found, "old_batch": old.get("batch"), "old_row": old.get("row")})

    def close(self) -> None:
        pass


def first_of_key(rows: DataFrame, key: str, order: Sequence[str], once: bool = False) -> DataFrame:
    """Changes of the first row per ``key`` of a stream: its columns, then ``old_batch, old_row``. ``rows`` has ``batch`` and
    ``row``, which say where a row is stored and decide ties; a null key is a key."""
    fields = [f for f in rows.schema.fields if f.name != key]
    schema = T.StructType(
        [rows.schema[key], *fields, T.StructField("old_batch", T.LongType()), T.StructField("old_row", T.LongType())]
    )
    processor = FirstOfKey(key, fields, [*order, "batch", "row"], once)
    return rows.groupBy(key).transformWithState(processor, schema, "Update", "None")
