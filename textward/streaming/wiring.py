"""Scans over streams: the same columns, blocked rows aside, counts by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textward.plans.config import Config
from textward.plans.guard import verdict


def scan_stream(stream: DataFrame, text: str = "text", direction: str = "input", config: Config | None = None) -> DataFrame:
    """Stateless: a stream's rows with the columns of :func:`verdict`."""
    return verdict(stream, text, direction, config)


def quarantine(stream: DataFrame, passed: str, blocked: str, checkpoint: str, trigger: dict | None = None):
    """Writes what passes and what is blocked to two folders; a batch that is tried again replaces its own part."""

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for flag, path in ((False, passed), (True, blocked)):
            batch.filter(F.col("blocked") == flag).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def blocked_counts(stream: DataFrame, ts: str, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Rows and blocked rows for each window of event time; rows later than ``late`` are dropped with the state."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.count("*").alias("n"), F.count_if("blocked").alias("n_blocked"))
