"""Projects that turn active with an update and inactive when none has come for a while, by state and timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

CHANGE = "org string, project string, active boolean, at timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Activity(StatefulProcessor):
    """One state per project: the last instant and whether it's active; one timer, at the last instant plus the interval.

    It emits changes only: active when an update comes within the interval of now, inactive when the timer fires,
    for which no input is needed.
    """

    def __init__(self, interval_ms: int, by_event: bool):
        self.interval, self.by_event = interval_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("last", "instant long, active boolean")

    def _change(self, key, active: bool, at: int) -> pd.DataFrame:
        return pd.DataFrame({"org": [key[0]], "project": [key[1]], "active": [active], "at": [pd.Timestamp(at, unit="ms")]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old, was = self.state.get() if self.state.exists() else (None, None)
        newest = max([int(r["instant_ms"].max()) for r in rows] + ([old] if old is not None else []))
        now = timerValues.getCurrentWatermarkInMs() if self.by_event else timerValues.getCurrentProcessingTimeInMs()
        due, active = newest + self.interval, newest + self.interval > now
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if active:
            self.handle.registerTimer(due)
        self.state.update((newest, active))
        if active != was:
            yield self._change(key, active, newest if active else due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        instant, was = self.state.get()
        self.state.update((instant, False))
        if was:
            yield self._change(key, False, instant + self.interval)

    def close(self) -> None:
        pass


def activity_changes(elements: DataFrame, interval_seconds: int, *, by_event: bool = True) -> DataFrame:
    """org, project, active, at: a stream of changes from a stream of elements (org, project, instant).

    by_event: now is the watermark, the greatest instant seen so far; else the clock, and idle projects turn inactive though
    nothing comes.  The state is kept in RocksDB, which this sets for queries that the session starts from now on.
    """
    elements.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = elements.select("org", "project", F.col("instant").cast("timestamp").alias("event_instant"))
    rows = rows.withColumn("instant_ms", F.unix_millis("event_instant"))
    if by_event:
        rows = rows.withWatermark("event_instant", "0 seconds")
    keyed = rows.groupBy("org", "project")
    return keyed.transformWithStateInPandas(Activity(interval_seconds * 1000, by_event), CHANGE, "Append", "EventTime" if by_event else "ProcessingTime")


def last_changes(changes: DataFrame) -> DataFrame:
    """The state of each project after all changes."""
    return changes.groupBy("org", "project").agg(F.max_by("active", F.struct("at", ~F.col("active"))).alias("active"))
