"""Event sequences and windows on streams. The batch forms are in ``operators/changes.py``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def chained_stream(events: DataFrame, flow: list[str], minutes: int = 30, late: str = "1 day") -> DataFrame:
    """(user_id, event_id, event_type, previous) for a stream of flow events.

    State per user: time and type of the last flow event. An event older than it is ignored, as late
    rows must not rewrite what was counted. Other events do not break a chain. Rows later than ``late``
    are dropped, and so is a user's state once no event in time can continue its chain.
    """
    gap = pd.Timedelta(minutes=minutes)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=["user_id", "event_id", "event_type", "previous"])
            return
        last_ts, last_type = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = []
        for event_id, kind, ts in zip(rows["event_id"], rows["event_type"], rows["ts"]):
            at = int(ts.value // 1000)
            if last_ts is not None and at < last_ts:
                continue
            near = last_ts is not None and at - last_ts <= gap.value // 1000
            out.append((key[0], event_id, kind, last_type if near else None))
            last_ts, last_type = at, kind
        if last_ts is not None:
            state.update((last_ts, last_type))
            state.setTimeoutTimestamp(max(last_ts // 1000 + gap.value // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "event_type", "previous"])

    rows = events.filter(F.col("event_type").isin(flow) & F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows = rows.withWatermark("ts", late)
    return rows.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, event_id long, event_type string, previous string", "last_ts long, last_type string", "append", GroupStateTimeout.EventTimeTimeout
    )


def windowed_stream(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and value per type and window; rows later than the watermark are dropped."""
    rows = events.filter("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("events"), F.sum(F.coalesce("value", F.lit(0.0))).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "events", "total")
