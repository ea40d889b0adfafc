"""Streams: windowed statistics of the query log, and a live rate limiter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.governance import TokenBucket


def windowed_stats(events: DataFrame, at: str = "ts", label: str = "event_type", value: str = "value", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(window_start, label, n, total) of tumbling windows; works alike on a
    stream, where rows later than ``late`` are dropped, and on a table."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    sums = rows.groupBy(F.window(at, window), F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 6).alias("total"))
    return sums.select(F.col("window.start").alias("window_start"), "label", "n", "total")


def live_rate_limit(calls: DataFrame, per_min: int) -> DataFrame:
    """(key, at, allowed, retry_after) for a stream of calls (key, at): each
    key's bucket is the operator's state and goes after an hour without calls."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        bucket = TokenBucket(per_min)
        if state.exists:
            bucket.state = tuple(state.get)
        for frame in frames:
            frame = frame.sort_values("s")
            got = [bucket.allow(s) for s in frame["s"]]
            yield pd.DataFrame({"key": key[0], "s": frame["s"], "allowed": [a for a, _ in got], "retry_after": [r for _, r in got]})
        if bucket.state is not None:
            state.update(bucket.state)
        state.setTimeoutDuration(3_600_000)

    rows = calls.select(F.col("key").cast("string").alias("key"), F.col("at").cast("double").alias("s"))
    out = rows.groupBy("key").applyInPandasWithState(run, "key string, s double, allowed boolean, retry_after int", "tokens double, at double", "append", GroupStateTimeout.ProcessingTimeTimeout)
    return out.select("key", F.col("s").cast("timestamp").alias("at"), "allowed", "retry_after")
