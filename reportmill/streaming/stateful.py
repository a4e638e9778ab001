"""Limiter, latest results and answers as streams with typed state and event-time timers.

State is what each answers for: values and maps with named fields in the RocksDB store, which
writes changes only. Timers remove it once the watermark has passed what it is needed for, so it is
bounded by time and by the keys of that time. Rows of one micro-batch are taken in event-time
order; across batches they come as they arrive, and those older than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from reportmill.operators import serving
from reportmill.shipping import ship

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ready(spark: SparkSession) -> None:
    """Typed state needs the RocksDB store; a session names its store for all of its streams."""
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _micros(ts: pd.Timestamp) -> int:
    return int(ts.value // 1000)


class _Timed(StatefulProcessor):
    """State that is removed when its last timer runs out; ``clear`` of a subclass removes it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def _keep_until(self, ms: int, now: int) -> None:
        timers = list(self.handle.listTimers())
        ms = max(ms, now + 1)
        if timers and max(timers) >= ms:
            return
        for t in timers:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Limiter(_Timed):
    """Two fixed windows: one for each route of a client and one over all that these let pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.routes = handle.getMapState("routes", "route string", "start bigint, n int")
        self.day = handle.getValueState("day", "start bigint, n int")

    def clear(self) -> None:
        self.routes.clear()
        self.day.clear()

    @staticmethod
    def _next(was: tuple | None, us: int, span: int) -> tuple[int, int]:
        return (us, 1) if was is None or us - was[0] >= span else (was[0], was[1] + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values("ts", kind="stable")
        day = self.day.get() if self.day.exists() else None
        routes: dict[str, tuple[int, int]] = {}
        passed, allowed = [], []
        for route, ts in zip(table["route"], table["ts"], strict=True):
            us = _micros(ts)
            if route not in routes and self.routes.containsKey((route,)):
                routes[route] = tuple(self.routes.getValue((route,)))
            routes[route] = self._next(routes.get(route), us, 60_000_000)
            ok = routes[route][1] <= serving.PER_MINUTE.get(route, 0)
            if ok:
                day = self._next(day, us, 86_400_000_000)
            passed.append(ok)
            allowed.append(ok and day[1] <= serving.PER_DAY)
        for route, window in routes.items():
            self.routes.updateValue((route,), window)
        if day is not None:
            self.day.update(tuple(day))
        ends = [start // 1000 + 60_000 for start, _ in routes.values()] + ([day[0] // 1000 + 86_400_000] if day is not None else [])
        self._keep_until(max(ends), timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame({"client": key[0], "route": table["route"], "ts": table["ts"], "route_ok": passed, "allowed": allowed})


def two_level_stream(requests: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """(client, route, ts, route_ok, allowed) of streamed (client, route, ts): :func:`serving.two_level` as a stream.

    A client's state is a window for each route and one for the day, removed once the watermark
    has passed the last of them.
    """
    _ready(requests.sparkSession)
    schema = "client string, route string, ts timestamp, route_ok boolean, allowed boolean"
    rows = requests.select("client", "route", "ts").withWatermark("ts", lateness)
    return rows.groupBy("client").transformWithStateInPandas(_Limiter(), schema, "Append", "EventTime")


class _Latest(_Timed):
    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ticket = handle.getValueState("ticket", "ticket bigint")

    def clear(self) -> None:
        self.ticket.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows))
        best = table.loc[table["ticket"].idxmax()]
        known = self.ticket.get()[0] if self.ticket.exists() else None
        self._keep_until(_micros(table["ts"].max()) // 1000 + self.keep_ms, timerValues.getCurrentWatermarkInMs())
        if known is None or best["ticket"] > known:
            self.ticket.update((int(best["ticket"]),))
            yield pd.DataFrame({"key": [key[0]], "ticket": [best["ticket"]], "value": [best["value"]]})


def latest_stream(results: DataFrame, keep: str = "10 minutes", lateness: str = "1 minute") -> DataFrame:
    """(key, ticket, value) each time a streamed (key, ticket, value, ts) result is newer than all before it.

    An older ticket's result that comes later is dropped, so the last row of a key is what
    :func:`serving.latest_by_ticket` gives. A key is forgotten ``keep`` after its last result.
    """
    _ready(results.sparkSession)
    ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = results.select("key", "ticket", "value", "ts").withWatermark("ts", lateness)
    return rows.groupBy("key").transformWithStateInPandas(_Latest(ms), "key string, ticket bigint, value string", "Append", "EventTime")


def debounce_stream(events: DataFrame, by: list[str], settle: str = "150 milliseconds", lateness: str = "1 minute", at: str = "ts") -> DataFrame:
    """:func:`serving.debounce` as a stream: a burst comes once, when the watermark has passed its end."""
    return serving.debounce(events.withWatermark(at, lateness), by, at, settle)


class _Answer(_Timed):
    """An answer's events by model and number: what waits for a gap, and what has been shown."""

    def __init__(self, patience_ms: int):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "model int, seq bigint", "type string, text string")
        self.at = handle.getValueState("at", "model int, next bigint, part bigint, begun boolean, over boolean")

    def clear(self) -> None:
        self.waiting.clear()
        self.at.clear()

    def _shown(self, held: dict[tuple[int, int], tuple[str, str]], at: list, final: bool) -> list[tuple]:
        """Take the events that can be shown off ``held``; with ``final``, gaps are not waited for."""
        out = []
        while True:
            model, nxt, part, begun, over = at
            here = sorted(seq for m, seq in held if m == model)
            if over or not here or (here[0] != nxt and not final):
                if final and not over and not begun and any(m > model for m, _ in held) and not here:
                    at[:3] = [min(m for m, _ in held if m > model), 0, part]
                    continue
                return out
            kind, text = held.pop((model, here[0]))
            at[1] = here[0] + 1
            if kind == "error" and not begun:
                later = [m for m, _ in held if m > model]
                at[0], at[1] = model + 1, 0
                out.append((part, "failed", model, text))
                if final and later:
                    at[0] = min(later)
            elif kind == "error":
                at[4] = True
                out.append((part, "error", model, text))
            else:
                at[3] = begun or text != ""
                out.append((part, "delta", model, text))
            at[2] = part + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows))
        at = list(self.at.get()) if self.at.exists() else [0, 0, 0, False, False]
        held = {tuple(k): tuple(v) for k, v in self.waiting.iterator()}
        before = set(held)
        for model, seq, kind, text in zip(table["model_ix"], table["seq"], table["type"], table["text"], strict=True):
            if model > at[0] or (model == at[0] and seq >= at[1]):
                held.setdefault((int(model), int(seq)), (kind, text))
        out = self._shown(held, at, final=False)
        for k in before - set(held):
            self.waiting.removeKey(k)
        for k in set(held) - before:
            self.waiting.updateValue(k, held[k])
        self.at.update(tuple(at))
        self._keep_until(_micros(table["ts"].max()) // 1000 + self.patience_ms, timerValues.getCurrentWatermarkInMs())
        yield self._table(key, out)

    @staticmethod
    def _table(key: tuple, out: list[tuple]) -> pd.DataFrame:
        columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
        text = lambda values: pd.Series(values, dtype=object)
        return pd.DataFrame({"answer_id": text([key[0]] * len(out)), "part": pd.Series(columns[0], dtype="int64"), "kind": text(columns[1]), "model_ix": pd.Series(columns[2], dtype="int32"), "text": text(columns[3])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = list(self.at.get()) if self.at.exists() else [0, 0, 0, False, False]
        held = {tuple(k): tuple(v) for k, v in self.waiting.iterator()}
        out = self._shown(held, at, final=True)
        self.clear()
        yield self._table(key, [*out, (at[2], "end", at[0], None)])


def answer_stream(events: DataFrame, patience: str = "30 seconds", lateness: str = "10 seconds") -> DataFrame:
    """(answer_id, part, kind, model_ix, text): answers of streamed events, in order, as they can be shown.

    Events have (answer_id, model_ix, seq, type, text, ts), seq from 0 for each model's try, and may
    come late, twice or out of order. Deltas are shown as soon as all before them are. An error of a
    model before any of its text came is ``failed``, and the next model's events follow; after that
    it ends the answer. ``patience`` after the last event (by the watermark) what still waits for a
    missing event is shown as it is, then ``end``, and the answer's state is removed.
    """
    _ready(events.sparkSession)
    ms = int(pd.Timedelta(patience).total_seconds() * 1000)
    rows = events.select("answer_id", "model_ix", "seq", "type", "text", "ts").withWatermark("ts", lateness)
    schema = "answer_id string, part bigint, kind string, model_ix int, text string"
    return rows.groupBy("answer_id").transformWithStateInPandas(_Answer(ms), schema, "Append", "EventTime")
