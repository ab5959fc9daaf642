"""A table replayed as a stream: its rows arrive in slices, a closing row moves the watermark past the last of them.

A watermark moves from batch to batch. So slices that are in order of time lose no row if each is one batch, however many
files it has (:func:`in_turn`); of one batch for every few files, the later ones of a slice may be too late.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textward.functions.columns import col, unused
from textward.streaming.table import folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: When the closing row happens.
FAR = "2200-01-01 00:00:00"
#: Its keys.
CLOSING = -(1 << 62)


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings (dots as two underscores) within a block."""
    keys = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


class Replay:
    """``arrive(rows)`` adds files to the stream; ``close(ts, keys)`` adds a row that is later than all; ``stream`` reads them."""

    def __init__(self, spark: SparkSession, schema, per_batch: int | None = 2):
        self.spark, self.schema, self.per_batch = spark, schema, per_batch
        self.path = folder(spark) + "/in"

    def arrive(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def slices(self, rows: DataFrame, by: Column, n: int) -> None:
        """All rows, in n slices: 0, 1, ..., what is above in the last."""
        for k in range(n):
            self.slice(rows, by, n, k)

    def slice(self, rows: DataFrame, by: Column, n: int, k: int) -> None:
        """One of the n slices."""
        (name,) = unused(rows, "slice")
        own = F.least(by, F.lit(n - 1)) == k
        self.arrive(rows.withColumn(name, own).filter(col(name)).drop(name))

    def close(self, ts: str, *keys: str) -> None:
        """The keys are CLOSING, not null: a join drops null keys before the watermark sees their times."""
        value = lambda f: F.lit(FAR).cast("timestamp") if f.name == ts else F.lit(CLOSING if f.name in keys else None).cast(f.dataType)
        self.arrive(self.spark.range(1).select(*(value(f).alias(f.name) for f in self.schema.fields)).coalesce(1))

    def stream(self) -> DataFrame:
        reader = self.spark.readStream.schema(self.schema)
        return (reader.option("maxFilesPerTrigger", self.per_batch) if self.per_batch else reader).parquet(self.path)


def drain(spark: SparkSession, build: Callable[[], DataFrame], at: str | None = None) -> tuple[DataFrame, list[dict]]:
    """Runs a stream until all that is there was read, into a table: the table, and the progress of its batches.

    ``at`` is where a query that ended, or was lost, goes on; a new one begins in a folder of its own.
    """
    at = at or folder(spark)
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS):
        stream = build()
        query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows"), [dict(p) for p in query.recentProgress]


def in_turn(spark: SparkSession, sides: list[tuple[Replay, DataFrame]], by: Column, n: int, ts: str, keys: tuple[str, ...], build: Callable[[], DataFrame]) -> tuple[DataFrame, list[dict]]:
    """Each slice of all sides arrives when the stream, which goes on where it was, has read the one before; then the closing rows.

    Without ``per_batch`` a slice is a batch. The table, and the progress of all batches.
    """
    at, told = folder(spark), []
    for k in range(n + 1):
        for side, rows in sides:
            side.slice(rows, by, n, k) if k < n else side.close(ts, *keys)
        out, progress = drain(spark, build, at)
        told += progress
    return out, told


def lost(progress: list[dict]) -> int:
    """How many rows came too late for the state of any operator."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in progress for op in p.get("stateOperators", []))
