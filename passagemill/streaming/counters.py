"""The window counter as a stream: counts per key and hour, with late rows up to the watermark."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hourly_counts(events: DataFrame, key: str = "user_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows per key and hour; ts without a zone counts as UTC, as watermarks need an instant."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return timed.groupBy(F.col(key), F.window("_ts", "1 hour").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def rate_limited(events: DataFrame, most: int, key: str = "user_id", ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """For each key and hour in arrival order: how many requests were allowed and how many refused, a row for each batch.

    An hour's state goes when the watermark is an hour past its end.
    """

    def count(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        new = sum(len(b) for b in batches)
        allowed = max(0, min(new, most - used))
        state.update((used + new,))
        ends = int(k[1].timestamp() * 1000) + 7_200_000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [k[0]], "hour": [k[1]], "allowed": [allowed], "refused": [new - allowed]})

    timed = events.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    return timed.withColumn("hour", F.date_trunc("hour", "at")).groupBy("key", "hour").applyInPandasWithState(
        count, "key long, hour timestamp, allowed long, refused long", "used long", "update", GroupStateTimeout.EventTimeTimeout
    )


class _Quota(StatefulProcessor):
    """One key's count in its newest window; a timer at the window's end takes it away."""

    def __init__(self, most: int, seconds: int, offset: int):
        self.most, self.seconds, self.offset = most, seconds, offset

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("quota", "start long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        start, used = self.state.get() if self.state.exists() else (None, 0)
        out, first = [], start
        for r in pd.concat(list(rows)).sort_values(["at", "id"], kind="stable").itertuples():
            now = r.at.timestamp()
            begun = int((now + self.offset) // self.seconds * self.seconds) - self.offset
            if start is not None and begun < start:  # late, for a window that is over
                continue
            if begun != start:
                start, used = begun, 0
            used = max(0, used - 1) if r.returned else used + 1
            out.append((key[0], r.id, start, used, bool(r.returned or used <= self.most), max(0, self.most - used), max(1, math.ceil(start + self.seconds - now))))
        if start is not None:
            self.state.update((start, used))
            if start != first:
                if first is not None:
                    self.handle.deleteTimer((first + self.seconds) * 1000)
                self.handle.registerTimer((start + self.seconds) * 1000)
        yield pd.DataFrame(out, columns=["key", "id", "start", "used", "allowed", "left", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def quota(events: DataFrame, most: int, seconds: int, offset: int, late: str = "0 seconds") -> DataFrame:
    """operators.intervals.quota as a stream: a row for each event (key, id, at, returned) as it comes; offset in seconds.

    State is a window's start and count for each key, until the watermark
    passes its end.  Events of one batch count in order of time, then id; one
    for a window before the key's newest is not counted.  Needs the RocksDB
    state store (spark.sql.streaming.stateStore.providerClass).
    """
    timed = events.select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.col("at").cast("timestamp").alias("at"), F.col("returned").cast("boolean").alias("returned"))
    return timed.withWatermark("at", late).groupBy("key").transformWithStateInPandas(
        _Quota(most, seconds, offset), "key long, id long, start long, used long, allowed boolean, `left` long, retry_after long", "Append", "EventTime"
    )
