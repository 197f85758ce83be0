"""The trailing-window rate limit as keyed state.

Each scope keeps the times of the last N events let through in a list state and the arriving events of every open cell of
time in a map state. A cell is judged, in (time, id) order, by the timer at its end, when the watermark says that nothing
earlier can arrive; a row is judged once and a late one is dropped by the watermark. When the newest time in the window is a
window old, a timer clears it, so an idle scope holds nothing. A scope has one timer at a time, for its first open cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shiftlens.operators.limiter import Slots
from shiftlens.streaming.cdc import STATE_PROVIDER

_MICROS = 1_000_000


def judge_cell(slots: Slots, times: np.ndarray, takes: np.ndarray) -> np.ndarray:
    """Which of the rows, sorted by (time, id), meet a full window; the ones that take a place are let through."""
    n, earlier = slots.taken.maxlen, np.array(slots.taken, np.int64)
    takers = np.flatnonzero(takes)
    passed = slots.walk(times[takers])
    let = np.zeros(len(times), np.int64)
    let[takers[passed]] = 1
    all_times = np.concatenate([earlier, times[takers[passed]]])
    before = len(earlier) + np.cumsum(let) - let  # let through before each row
    full = before >= n
    full[full] = all_times[before[full] - n] >= times[full] - slots.width
    return full


class KeyedLimiter(StatefulProcessor):
    def __init__(self, max_events: int, width: int, cell: int, id_type: str) -> None:
        self.n, self.width, self.cell, self.id_type = max_events, width, cell, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._window = handle.getListState("window", "t bigint")
        self._held = handle.getMapState("held", "cell bigint", f"t array<bigint>, id array<{self.id_type}>, takes array<boolean>")

    def _timer(self, micros: int, watermark: int) -> None:
        """The scope's next timer, unless an earlier one is still to come; those up to the watermark are just being handled."""
        at = -(-micros // 1000)
        if not any(watermark < t <= at for t in self._handle.listTimers()):
            self._handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = {c for (c,) in self._held.keys()}
        first = None
        for part in rows:
            for cell, some in part.groupby(part["t"] // self.cell):
                fresh = some["t"].tolist(), some["event_id"].tolist(), some["takes"].tolist()
                if cell in known:
                    fresh = tuple([*old, *new] for old, new in zip(self._held.getValue((cell,)), fresh, strict=True))
                self._held.updateValue((cell,), fresh)
                known.add(cell)
                first = cell if first is None else min(first, cell)
        if first is not None:
            self._timer((first + 1) * self.cell, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        closed = watermark * 1000 // self.cell  # cells below have ended
        slots = Slots(self.n, self.width, [t for (t,) in self._window.get()] if self._window.exists() else [])
        held = {cell: rows for (cell,), rows in self._held.iterator()}
        due = sorted(c for c in held if c < closed)
        for cell in due:
            rows = pd.DataFrame(dict(zip(("t", "event_id", "takes"), held.pop(cell), strict=True)))
            rows = rows.drop_duplicates(["t", "event_id"]).sort_values(["t", "event_id"], kind="stable")
            full = judge_cell(slots, rows["t"].to_numpy(np.int64), rows["takes"].to_numpy(bool))
            yield pd.DataFrame({"scope": key[0], "event_id": rows["event_id"], "t": rows["t"], "rate_limited": full})
        if not held:
            self._held.clear()
        else:
            for cell in due:
                self._held.removeKey((cell,))
            self._timer((min(held) + 1) * self.cell, watermark)
        if due and slots.taken:
            self._window.put([(t,) for t in slots.taken])
        if slots.taken and slots.taken[-1] + self.width < closed * self.cell:
            self._window.clear()
        elif slots.taken:
            self._timer(slots.taken[-1] + self.width + self.cell, watermark)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._window.put([(int(t),) for t in sorted(initialState["t"])[-self.n :]])
        self._timer(int(initialState["t"].max()) + self.width + self.cell, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def limited_stream(
    events: DataFrame,
    slot_taker: str,
    *,
    scope: str | None = None,
    time: str = "detected_at",
    event_id: str = "event_id",
    lateness: str = "1 hour",
    cell_seconds: int = 600,
    max_events: int = 10,
    window_seconds: int = 3600,
    prior: DataFrame | None = None,
) -> DataFrame:
    """(scope, event_id, t, rate_limited) of every event whose cell is closed, each once: the streaming twin of ``limiter.rate_limit``.

    ``prior`` (scope, t) are the times let through before a first start; a restart takes them from its checkpoint.
    Rows with equal scope, time and id are one event.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)
    width, cell = window_seconds * _MICROS, cell_seconds * _MICROS
    at = F.col(time).cast("timestamp")
    keyed = events.select(
        (F.col(scope).cast("string") if scope else F.lit("global")).alias("scope"),
        at.alias("at"),
        F.unix_micros(at).alias("t"),
        F.col(event_id).alias("event_id"),
        F.col(slot_taker).alias("takes"),
    ).withWatermark("at", lateness)
    id_type = keyed.schema["event_id"].dataType.simpleString()
    return keyed.groupBy("scope").transformWithStateInPandas(
        statefulProcessor=KeyedLimiter(max_events, width, cell, id_type),
        outputStructType=f"scope string, event_id {id_type}, t bigint, rate_limited boolean",
        outputMode="Append",
        timeMode="EventTime",
        initialState=prior.select("scope", "t").groupBy("scope") if prior is not None else None,
    )
