"""Live activity as Structured Streaming: the same operators over streams of events."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def recent_sessions(events: DataFrame, at: str, session: str, watermark: str = "10 minutes", slot: str = "1 minute") -> DataFrame:
    """The last event of each session by time slot; late events wait for the watermark."""
    return events.withWatermark(at, watermark).groupBy(F.window(at, slot), session).agg(F.max(at).alias("last_at"), F.count(F.lit(1)).alias("n"))


def activity(events: DataFrame, at: str, minutes: int, watermark: str = "10 minutes") -> DataFrame:
    counted = events.withWatermark(at, watermark).groupBy(F.window(at, f"{minutes} minutes")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("bucket_start"), "n")


def live_sessions(events: DataFrame, at: str, keys: list[str], gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Sessions by inactivity gaps, emitted once no late event can reach them."""
    found = events.withWatermark(at, watermark).groupBy(*keys, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))
    return found.select(*keys, F.col("session_window.start").alias("started_at"), F.col("session_window.end").alias("closes_at"), "n")


def without_repeats(events: DataFrame, at: str, keys: list[str], watermark: str = "10 minutes") -> DataFrame:
    """Drops events that come again within the watermark."""
    return events.withWatermark(at, watermark).dropDuplicatesWithinWatermark(keys)


def upsert_batches(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `apply` on each micro-batch once what is new is there; restarts go on
    from the checkpoint, so `apply` must be an upsert."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_totals(events: DataFrame, key: str, at: str, value: str, idle: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """key, n, total, last_at of each key after every batch that touches it, from a
    state of one row a key; a key that is idle beyond the watermark is forgotten."""
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def update(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, total, last = state.get if state.exists else (0, 0.0, 0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame[value].fillna(0).sum())
            last = max(last, int(frame["_ms"].max()))
        state.update((n, total, last))
        # batches come in any order of event time: a timeout lies after the watermark
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"key": [keys[0]], "n": [n], "total": [total], "last_ms": [last]})

    slim = events.withWatermark(at, watermark).select(F.col(key).alias("key"), at, F.col(value).cast("double").alias(value), F.unix_millis(at).alias("_ms"))
    kind = slim.schema["key"].dataType.simpleString()
    return slim.groupBy("key").applyInPandasWithState(
        update, f"key {kind}, n long, total double, last_ms long", "n long, total double, last_ms long", "update", GroupStateTimeout.EventTimeTimeout
    )
