"""The queue operators over streams: deliveries deduplicated within a watermark, leases timed out by state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def stream_table(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A Parquet folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedupe_stream(deliveries: DataFrame, key: list[str], time: str, delay: str) -> DataFrame:
    """One delivery of each key within the watermark's delay (ST1); state is dropped behind it."""
    return deliveries.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed_counts(events: DataFrame, time: str, delay: str, width: str, by: list[str]) -> DataFrame:
    """Events by tumbling window: our own extension, which the queue has no counterpart of."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))


class LeaseProcessor(StatefulProcessor):
    """The state of a job by its key (ST2, ST7): a claim leases it until a time, a completion settles it, and a
    lease that no completion meets in time makes it available once more, until attempts run out. A batch's
    actions count in the order of their times. An expiry is a timer on the watermark, so it comes out though
    no other action does; a timer that a completion has overtaken finds nothing to do."""

    def __init__(self, lease_ms: int, maximum_attempts: int):
        self.lease_ms, self.maximum_attempts = lease_ms, maximum_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, attempt int, until long")

    def _expired(self, attempt: int) -> str:
        return "available" if attempt < self.maximum_attempts else "failed"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, attempt, until = self.job.get() if self.job.exists() else ("available", 0, 0)
        out = []
        actions = sorted((int(at.timestamp() * 1000), action) for frame in rows for at, action in zip(frame["at"], frame["action"], strict=True))
        for at, action in actions:
            if state == "leased" and at >= until:
                state = self._expired(attempt)
                out.append((key[0], until, state, attempt))
            if action == "claim" and state == "available":
                state, attempt, until = "leased", attempt + 1, at + self.lease_ms
            elif action == "complete" and state == "leased":
                state = "completed"
            out.append((key[0], at, state, attempt))
        self.job.update((state, attempt, until))
        if state == "leased":
            self.handle.registerTimer(until)
        yield pd.DataFrame(out, columns=["job", "at_ms", "state", "attempt"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, attempt, until = self.job.get() if self.job.exists() else ("available", 0, 0)
        due = state == "leased" and until <= expiredTimerInfo.getExpiryTimeInMs()
        if due:
            state = self._expired(attempt)
            self.job.update((state, attempt, until))
        yield pd.DataFrame([(key[0], until, state, attempt)] if due else [], columns=["job", "at_ms", "state", "attempt"])

    def close(self) -> None:
        pass


def lease_states(actions: DataFrame, lease_ms: int = 60_000, maximum_attempts: int = 3, delay: str = "0 seconds") -> DataFrame:
    """The state after each of a stream's actions(job, action, at: timestamp), and at each lease's expiry."""
    return (
        actions.withWatermark("at", delay)
        .groupBy("job")
        .transformWithStateInPandas(statefulProcessor=LeaseProcessor(lease_ms, maximum_attempts), outputStructType="job string, at_ms long, state string, attempt int", outputMode="Append", timeMode="EventTime")
    )
