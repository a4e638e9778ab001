"""The request limiter and the answer stream as Structured Streaming queries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from reportmill.operators import serving

OUT = "key string, ts timestamp, nth int, allowed boolean"


def limit_stream(requests: DataFrame, limit: int, seconds: float, lateness: str = "1 minute") -> DataFrame:
    """(key, ts, nth, allowed) of streamed (key, ts) requests.

    A key's window starts at its first request after the last window. Requests of one batch
    are taken in event-time order; across batches in order of arrival, and those older than
    the watermark are dropped by Spark. State is two numbers a key, removed once the
    watermark has passed its window, so it is bounded by time and not by the number of keys.
    """
    span = pd.Timedelta(seconds=seconds)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, nth = state.get if state.exists else (None, 0)
        start = None if start is None else pd.Timestamp(start, unit="us")
        rows = pd.concat(list(frames)).sort_values("ts")
        counts = []
        for ts in rows["ts"]:
            if start is None or ts - start >= span:
                start, nth = ts, 0
            nth += 1
            counts.append(nth)
        ends = int((start + span).value // 1_000_000)
        state.update((int(start.value // 1000), nth))
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "ts": rows["ts"], "nth": pd.array(counts, "int32"), "allowed": [n <= limit for n in counts]})

    return (
        requests.withWatermark("ts", lateness)
        .groupBy("key")
        .applyInPandasWithState(step, OUT, "start bigint, nth int", "append", GroupStateTimeout.EventTimeTimeout)
    )


TWO_LEVEL = "client string, route string, ts timestamp, route_ok boolean, allowed boolean"


def two_level_stream(requests: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """(client, route, ts, route_ok, allowed) of streamed (client, route, ts) requests.

    As :func:`serving.two_level`: the route's minute first, and a client's day counts only what that
    let pass. A client's state is two numbers a route and two for the day, removed once the
    watermark has passed its day.
    """
    minute, day = pd.Timedelta(seconds=60), pd.Timedelta(days=1)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        windows = json.loads(state.get[0]) if state.exists else {}

        def counted(name: str, ts: pd.Timestamp, span: pd.Timedelta) -> int:
            start, n = windows.get(name, (None, 0))
            if start is None or ts - pd.Timestamp(start, unit="us") >= span:
                start, n = int(ts.value // 1000), 0
            windows[name] = (start, n + 1)
            return n + 1

        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        passed, allowed = [], []
        for route, ts in zip(rows["route"], rows["ts"], strict=True):
            passed.append(counted(f"route {route}", ts, minute) <= serving.PER_MINUTE.get(route, 0))
            allowed.append(passed[-1] and counted("day", ts, day) <= serving.PER_DAY)
        ends = max(start for start, _ in windows.values()) // 1000 + int(day.total_seconds() * 1000)
        state.update((json.dumps(windows),))
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "route": rows["route"], "ts": rows["ts"], "route_ok": passed, "allowed": allowed})

    return (
        requests.withWatermark("ts", lateness)
        .groupBy("client")
        .applyInPandasWithState(step, TWO_LEVEL, "windows string", "append", GroupStateTimeout.EventTimeTimeout)
    )


def answer_stream(lines: DataFrame) -> DataFrame:
    """Streamed NDJSON lines as events; use with complete or update mode of ``assemble``."""
    return serving.parse_events(lines)


def counted_windows(events: DataFrame, key: str = "event_type", width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Event counts and sums per tumbling window and key, with late data bounded."""
    w = F.window("ts", width)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", lateness).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), key, "n", "value")
