"""Streams of requests: sliding-window rate limiter, and call costs by event-time window."""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALLOWED = "user_id long, event_id long, allowed boolean, retry_after int"


def rate_limited(events: DataFrame, most: int, window_s: float, late: str = "10 minutes") -> DataFrame:
    """ALLOWED for a stream of (user_id, event_id, ts): each user's admitted times are the state, at most `most` of them.

    Within a micro-batch a user's requests are taken in time order. Time is that of the events: requests
    later than `late` are dropped by the watermark, which follows the ends of the requests' windows, and the
    state goes once no request that is still taken can fall within its last window, however slow the stream is.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([b[["t", "event_id"]] for b in batches]).sort_values(["t", "event_id"])
        held = sorted(state.get[0]) if state.exists else []
        allowed, retry = [], []
        for now in rows["t"].tolist():
            del held[: bisect.bisect_left(held, now - window_s)]
            allowed.append(len(held) < most)
            retry.append(0 if allowed[-1] else int(held[0] + window_s - now) + 1 if held else math.ceil(window_s))
            if allowed[-1]:
                bisect.insort(held, now)
        state.update((held,))
        state.setTimeoutTimestamp(int((max([now, *held[-1:]]) + 2 * window_s) * 1000) + 1)
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].tolist(), "allowed": allowed, "retry_after": retry})

    own = events.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts")).where("ts is not null")
    own = own.withColumns({"t": F.col("ts").cast("double"), "ends": F.timestamp_micros(F.unix_micros("ts") + int(window_s * 1e6))}).withWatermark("ends", late).drop("ts")
    return own.groupBy("user_id").applyInPandasWithState(step, ALLOWED, "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def costs_by_window(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) of a stream of (ts, event_type, value) by event-time windows; later rows than `late` are dropped by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
