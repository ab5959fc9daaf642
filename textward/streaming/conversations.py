"""Risk over a conversation: the worst turn so far, and early exit that holds for the turns after it.

A conversation's turns fall into sessions: a gap of more than ``gap`` seconds begins a new one, with nothing held against
it. Within a session turns are taken by their time. Once a turn has a critical finding the later ones are stopped: they
have no risk of their own. The stream gives the rows of the batch, whatever the order in which turns arrive within the
watermark's delay: turns wait until the watermark has passed them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from textward.plans.config import Config
from textward.plans.guard import verdict

GAP = 1800
#: From this score on a finding is critical.
CRITICAL = 0.9
WAITING = "ts long, turn long, risk double"
NOW = "last long, session long, running double, criticals long"
OUT = "conv_id long, turn long, session long, risk double, running_risk double, criticals long, stopped boolean"


def scored(turns: DataFrame, direction: str = "input", config: Config | None = None) -> DataFrame:
    """conv_id, turn, ts and risk of turns (conv_id, turn, ts, text)."""
    return verdict(turns, "text", direction, config).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "ts", F.col("risk_score").alias("risk"))


def running_risk(turns: DataFrame, gap: int = GAP, direction: str = "input", config: Config | None = None) -> DataFrame:
    """OUT for a table of turns, by windows over each conversation. Turns of one time go by number, then by risk; rows without a conversation or a time are left out."""
    by = W.partitionBy("conv_id").orderBy("ts", "turn", "risk")
    rows = scored(turns, direction, config).filter("conv_id is not null and ts is not null")
    rows = rows.withColumn("new", (F.unix_millis("ts") - F.lag(F.unix_millis("ts")).over(by) > gap * 1000).cast("long"))
    rows = rows.withColumn("session", F.coalesce(F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    own = W.partitionBy("conv_id", "session").orderBy("ts", "turn", "risk")
    critical = F.col("risk") >= CRITICAL
    rows = rows.withColumn("stopped", F.coalesce(F.max(critical).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    rows = rows.withColumn("risk", F.when(~F.col("stopped"), F.col("risk")))
    # a stopped turn, whose risk is now null, comes after the critical one whatever its place among turns of one time
    upto = W.partitionBy("conv_id", "session").orderBy("ts", "turn", F.col("risk").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    criticals = F.coalesce(F.sum((F.col("risk") >= CRITICAL).cast("long")).over(upto), F.lit(0))
    return rows.select("conv_id", "turn", "session", "risk", F.max("risk").over(upto).alias("running_risk"), criticals.alias("criticals"), "stopped")


class Sessions(StatefulProcessor):
    """The state of a conversation: turns that wait for the watermark, and what is known of the session so far."""

    def __init__(self, gap: int):
        self.gap = gap * 1000

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.now = handle.getValueState("now", NOW)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # numpy's integers aren't the state's
        new = [(int(t), int(n), float(r)) for pdf in rows for t, n, r in zip(pdf["ms"], pdf["turn"], pdf["risk"], strict=True)]
        self.waiting.appendList(new)
        # a timer ends when the watermark reaches it, a turn is due when the watermark has passed it
        for ms in {t for t, _, _ in new}:
            self.handle.registerTimer(ms + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the first timer that ends takes all turns that are due; the others find none, or that a gap has passed
        mark, held = timerValues.getCurrentWatermarkInMs(), list(self.waiting.get())
        due = sorted(tuple(x) for x in held if x[0] < mark)
        last, session, running, criticals = self.now.get() if self.now.exists() else (None, 0, None, 0)
        out = []
        for ts, turn, risk in due:
            if last is not None and ts - last > self.gap:
                session, running, criticals = session + 1, None, 0
            last, stopped = ts, criticals > 0
            if not stopped:
                running = risk if running is None else max(running, risk)
                criticals += risk >= CRITICAL
            out.append((key[0], turn, session, None if stopped else risk, running, criticals, stopped))
        if due:
            left = [tuple(x) for x in held if x[0] >= mark]
            self.waiting.put(left) if left else self.waiting.clear()
            # what is held against a conversation goes when the gap has passed; its sessions go on being numbered
            self.handle.registerTimer(last + self.gap + 1)
            self.now.update((last, session, running, criticals))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])
        elif last is not None and not held and mark > last + self.gap:
            self.now.update((last, session, None, 0))

    def close(self) -> None:
        pass


def running_risk_stream(turns: DataFrame, gap: int = GAP, late: str = "10 minutes", direction: str = "input", config: Config | None = None) -> DataFrame:
    """The same for a stream. Turns later than ``late`` are dropped and counted (:func:`textward.streaming.replay.lost`).

    Rows without a conversation or a time are left out. Needs the RocksDB state store. A conversation's state is its waiting turns, those of the last ``late``, and one row.
    """
    rows = scored(turns, direction, config).filter("conv_id is not null and ts is not null").withWatermark("ts", late)
    rows = rows.withColumn("ms", F.unix_millis("ts")).withColumn("turn", F.coalesce("turn", F.lit(-1)))
    return rows.groupBy("conv_id").transformWithStateInPandas(Sessions(gap), OUT, "Append", "EventTime")
