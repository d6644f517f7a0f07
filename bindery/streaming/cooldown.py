"""Cool-down of blocked sources: a block holds back what comes for its source, and a timer releases it.

Rows are (source_id, at, reason): with a reason they report a block, without one they ask to visit the source. Two clocks are kept apart.
Whether a visit is held is decided by the rows' own times, so a replay decides as the first run did. The release is for
those who wait, so it comes by the processing clock, when the cool-down has passed since the last block came in.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOURS = 24
EVENTS = "source_id string, event string, at timestamp, retry_after timestamp, reason string"


class Cooldown(StatefulProcessor):
    """State of one source: when it may be asked again, why it was blocked, and the timer that is set for its release."""

    def __init__(self, seconds: float):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", "retry_after timestamp, reason string, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state, out, blocked = self.block.get() if self.block.exists() else None, [], False
        until, reason, timer = state or (None, None, None)
        pdf, wait = pd.concat(list(rows)).sort_values(["at", "seq"], kind="stable"), dt.timedelta(seconds=self.seconds)
        for at, why in zip(pdf["at"].array.to_pydatetime(), pdf["reason"], strict=True):
            if isinstance(why, str):
                until, reason, blocked = at + wait if until is None else max(until, at + wait), why, True
                out.append((key[0], "blocked", at, until, reason))
            else:
                held = until is not None and at < until
                out.append((key[0], "held" if held else "open", at, until if held else None, reason if held else None))
        if blocked:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + int(self.seconds * 1000)
            self.handle.registerTimer(timer)
            self.block.update((until, reason, timer))
        yield pd.DataFrame(out, columns=["source_id", "event", "at", "retry_after", "reason"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        until, reason, _ = self.block.get()
        self.block.clear()
        now = pd.Timestamp(timerValues.getCurrentProcessingTimeInMs(), unit="ms")
        yield pd.DataFrame([(key[0], "released", now, until, reason)], columns=["source_id", "event", "at", "retry_after", "reason"])

    def close(self) -> None:
        pass


def cooled_stream(stream: DataFrame, hours: float = HOURS) -> DataFrame:
    """What happens to each row of a stream of (source_id, at, seq, reason), and the releases; seq orders rows of one time."""
    df = stream.select(F.col("source_id").cast("string").alias("source_id"), "at", "seq", "reason")
    return df.groupBy("source_id").transformWithStateInPandas(Cooldown(hours * 3600), outputStructType=EVENTS, outputMode="Append", timeMode="ProcessingTime")


def cooled(df: DataFrame, hours: float = HOURS) -> DataFrame:
    """The batch twin, without releases: each row against the blocks before it."""
    before = Window.partitionBy("source_id").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    wait = F.expr(f"INTERVAL {round(hours * 3600)} SECONDS")
    df = df.select(F.col("source_id").cast("string").alias("source_id"), "at", "seq", "reason")
    df = df.withColumns({"until": F.max(F.when(F.col("reason").isNotNull(), F.col("at") + wait)).over(before), "why": F.last("reason", ignorenulls=True).over(before)})
    held = F.col("at") < F.col("until")
    event = F.when(F.col("reason").isNotNull(), "blocked").when(held, "held").otherwise("open")
    return df.select("source_id", event.alias("event"), "at", F.when(event != "open", F.col("until")).alias("retry_after"), F.when(event != "open", F.col("why")).alias("reason"))
