"""Latest status per entity, daily quotas and task states over streams.

State is bounded: quotas expire with the watermark, and the others hold one small row for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_status(events: DataFrame, key: str, status: str, seq: str) -> DataFrame:
    """The status with the highest sequence number seen for each key, in update mode."""
    return events.groupBy(key).agg(F.max_by(status, seq).alias(status), F.max(seq).alias(seq))


def quota_use(events: DataFrame, source: str, ts: str, limit: int, delay: str = "1 day") -> DataFrame:
    """Uses per source and day, and how many stay within the limit; a day's state goes once the watermark has passed it."""
    day = F.window(ts, "1 day").alias("day")
    used = events.withWatermark(ts, delay).groupBy(source, day).agg(F.count("*").alias("used"))
    return used.select(source, F.col("day.start").cast("date").alias("day"), "used", F.least("used", F.lit(limit).cast("long")).alias("allowed"))


def task_states(events: DataFrame, key: str, status: str, seq: str, max_attempts: int = 3) -> DataFrame:
    """(key, attempts, task_status): a success ends a task, failures count up to ``max_attempts``. Results of a batch are taken in order of ``seq``."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, now = state.get if state.exists else (0, "PENDING")
        rows = pd.concat(list(batches)).sort_values(seq)
        for result in rows[status]:
            if now == "PENDING":
                attempts += 1
                now = "DONE" if result == "SUCCESS" else "ERROR" if attempts >= max_attempts else "PENDING"
        state.update((attempts, now))
        yield pd.DataFrame({key: [k[0]], "attempts": [attempts], "task_status": [now]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, attempts int, task_status string", "attempts int, task_status string", "update", GroupStateTimeout.NoTimeout)
