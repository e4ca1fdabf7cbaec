"""Tasks as timed state: back-off wakes them, and finished ones are forgotten.

Every key has one value and one timer. What a timer does depends on event time alone: a result that comes after a
timer's time lets it fire first, and a timer that the watermark passes fires without one. So the actions are the same
however the stream is cut into batches, as long as results are no later than the watermark's delay.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Tasks(StatefulProcessor):
    """Results (t in milliseconds, status) of one key to actions (key, t, action, attempts)."""

    def __init__(self, key: str, status: str, seq: str, base: int, most: int, keep: int) -> None:
        self.names, self.base, self.most, self.keep = (key, status, seq), base, most, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", "attempts int, status string, t long")  # t: next try, or end of memory; 0: woken

    def _keep(self, before: tuple | None, task: tuple | None) -> None:
        """Write what became of a task; its one timer is that of its time."""
        if task == before:
            return
        if before and before[2] and (task is None or task[2] != before[2]):
            self.handle.deleteTimer(before[2])
        if task is None:
            self.state.clear()
            return
        self.state.update(task)
        if task[2] and (before is None or task[2] != before[2]):
            self.handle.registerTimer(task[2])

    @staticmethod
    def _after(task: tuple, out: list[tuple]) -> tuple | None:
        """The task when its timer's time has come."""
        attempts, status, t = task
        out.append((t, "WAKE" if status == "PENDING" else "EXPIRED", attempts))
        return (attempts, status, 0) if status == "PENDING" else None

    def _rows(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame({self.names[0]: [key[0]] * len(out), "t": [o[0] for o in out], "action": [o[1] for o in out], "attempts": [o[2] for o in out]})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        _, status, seq = self.names
        out: list[tuple] = []
        frames = list(rows)
        results = sorted(zip(*(np.concatenate([f[c].to_numpy() for f in frames]).tolist() for c in ("t", seq, status)), strict=True), key=lambda r: r[:2])
        # the state is read once and written once: every call to it goes to the JVM and back
        before = task = tuple(self.state.get()) if self.state.exists() else None
        for t, _, result in results:
            if task and 0 < task[2] < t:
                task = self._after(task, out)
            attempts, now, _ = task or (0, "PENDING", 0)
            if now != "PENDING":
                continue  # a finished task's result
            attempts += 1
            if result != "SUCCESS" and attempts < self.most:
                task = attempts, "PENDING", t + self.base * attempts
            else:
                now = "DONE" if result == "SUCCESS" else "ERROR"
                out.append((t, now, attempts))
                task = attempts, now, t + self.keep
        self._keep(before, task)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out: list[tuple] = []
        before = tuple(self.state.get()) if self.state.exists() else None
        if before and before[2] == expiredTimerInfo.getExpiryTimeInMs():
            self._keep(before, self._after(before, out))
        yield from self._rows(key, out)

    def close(self) -> None:
        pass


def task_actions(results: DataFrame, key: str, status: str, ts: str, seq: str, base_minutes: int = 15, max_attempts: int = 3, keep_ms: int = DAY, delay: str = "1 hour") -> DataFrame:
    """(key, t, action, attempts) of a stream of task results: DONE, ERROR, WAKE when a retry's time comes, EXPIRED when a finished task is forgotten.

    Times are milliseconds. A result after a task was forgotten begins a new one. Needs the RocksDB state store (``rocks``).
    """
    t = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    rows = results.select(key, status, seq, t.alias("t")).withColumn("at", F.timestamp_millis("t")).withWatermark("at", delay)
    kind = results.schema[key].dataType.simpleString()
    tasks = Tasks(key, status, seq, base_minutes * 60_000, max_attempts, keep_ms)
    return rows.groupBy(key).transformWithStateInPandas(tasks, f"{key} {kind}, t long, action string, attempts int", "Append", "EventTime")


@contextlib.contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The state store that timed state needs, for streams that start inside."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
