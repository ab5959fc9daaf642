"""Metrics of a scan from its own pass: rows, rows spared by early exit, hits and blocks of each check; durations by a listener."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from textward.functions.columns import col
from textward.plans import guard
from textward.plans.config import Config

FIELDS = ("ran", "spared", "hits", "failed")


def metrics(scan: str, config: Config, direction: str, checks: list[str] | None = None) -> dict[str, Column]:
    """Aggregates over a scan's struct: n_rows, n_blocked, and for each planned check ran, spared, hits and failed."""
    s, out = col(scan), {"n_rows": F.count(F.lit(1)), "n_blocked": F.count_if(col(scan)["blocked"])}
    for i, _ in guard.planned(config, direction, checks):
        c = F.try_element_at(s["checks"], F.lit(i))
        each = (F.count_if(c.isNotNull()), F.count_if(c.isNull()), F.count_if(F.coalesce(c["score"] > 0, F.lit(False))), F.count_if(F.coalesce(~c["passed"], F.lit(False))))
        out |= {f"{i}_{name}": x for name, x in zip(FIELDS, each, strict=True)}
    return out


def observed(df: DataFrame, observation: Observation | str, text: str = "text", direction: str = "input", config: Config | None = None, checks: list[str] | None = None, out: str = "scan") -> DataFrame:
    """As :func:`textward.plans.guard.scan`, with the metrics told to ``observation`` when the rows are written: no second job.

    On a stream ``observation`` is a name; the metrics are in each batch's progress, where :class:`Durations` finds them.
    """
    config = config or Config()
    scanned = guard.scan(df, text, direction, config, checks=checks, out=out)
    told = metrics(out, config, direction, checks)
    return scanned.observe(observation, *(c.alias(n) for n, c in told.items()))


def timed(df: DataFrame, write: Callable[[DataFrame], None], **kw) -> dict:
    """Scans and writes once; the metrics, the seconds it took and the milliseconds for each row."""
    observation, began = Observation(), time.monotonic()
    write(observed(df, observation, **kw))
    seconds = time.monotonic() - began
    got = dict(observation.get)
    return got | {"seconds": seconds, "ms_per_row": 1000 * seconds / got["n_rows"] if got["n_rows"] else None}


class Durations(StreamingQueryListener):
    """Collects, for each batch of the streams that tell of ``name``, its metrics, its rows and its milliseconds."""

    def __init__(self, name: str):
        self.name, self.batches = name, []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.name in p.observedMetrics:
            self.batches.append({"batch": p.batchId, "rows": p.numInputRows, "ms": p.batchDuration, "metrics": p.observedMetrics[self.name].asDict()})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
