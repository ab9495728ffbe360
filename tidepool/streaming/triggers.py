"""Micro-batch triggers as keyed state with timers: how much is pending for each key, since when, and when a job last ran."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FIRED = "key string, fired_at timestamp, pending bigint, reason string"
_STATE = "pending bigint, first bigint, last bigint"


class Trigger(StatefulProcessor):
    """Fires a key's job once ``count`` rows or ``interval_ms`` have come together, and not within that time of its last run.

    Rows are taken in the order of their times. What no row decides a timer does, once the watermark has passed it.
    """

    def __init__(self, count: int, interval_ms: int):
        self.count, self.interval = count, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pending", _STATE)

    def _load(self) -> tuple[int, int | None, int | None]:
        return tuple(self.state.get()) if self.state.exists() else (0, None, None)

    def _due(self, pending: int, first: int | None, last: int | None) -> int | None:
        """When the job is due if nothing more comes."""
        if not pending:
            return None
        return last + self.interval if pending >= self.count and last is not None else first + self.interval

    def _rows(self, key: tuple, fired: list[tuple[int, int, str]]) -> pd.DataFrame:
        return pd.DataFrame({"key": [str(key[0])] * len(fired), "fired_at": pd.to_datetime([t for t, _, _ in fired], unit="ms", utc=True), "pending": [n for _, n, _ in fired], "reason": [r for _, _, r in fired]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        pending, first, last = self._load()
        fired = []
        for at in sorted(int(t) for part in rows for t in part["at"]):  # one key's rows of a micro-batch
            due = self._due(pending, first, last)
            if due is not None and due <= at:
                fired.append((due, pending, "age" if pending < self.count else "count"))
                pending, first, last = 0, None, due
            pending, first = pending + 1, at if first is None else first
            if pending >= self.count and (last is None or at - last >= self.interval):
                fired.append((at, pending, "count"))
                pending, first, last = 0, None, at
        self._keep(pending, first, last)
        if fired:
            yield self._rows(key, fired)

    def _keep(self, pending: int, first: int | None, last: int | None) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((pending, first, last))
        due = self._due(pending, first, last)
        if due is not None:
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pending, first, last = self._load()
        due = self._due(pending, first, last)
        if due is not None and due <= expiredTimerInfo.getExpiryTimeInMs():
            self._keep(0, None, due)
            yield self._rows(key, [(due, pending, "age" if pending < self.count else "count")])

    def close(self) -> None:
        pass


def firings(rows: DataFrame, key: str, time: str, count: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(key, fired_at, pending, reason) of a stream's rows (key, time); the state store must be RocksDB's."""
    timed = rows.selectExpr(f"CAST({key} AS STRING) AS key", f"CAST({time} AS TIMESTAMP) AS ts").withWatermark("ts", late).selectExpr("key", "ts", "unix_millis(ts) AS at")
    return timed.groupBy("key").transformWithStateInPandas(Trigger(count, seconds * 1000), FIRED, "Append", "EventTime")


def run(rows: DataFrame, target: str, checkpoint: str, key: str, time: str, count: int, seconds: int, late: str = "10 minutes"):
    """Appends a stream's firings to a folder; keeps the state in RocksDB."""
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        made = firings(rows, key, time, count, seconds, late)
        query = made.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
        query.processAllAvailable()
        return query
    finally:
        conf.unset(name) if before is None else conf.set(name, before)
