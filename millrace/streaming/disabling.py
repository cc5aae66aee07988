"""Disabling and enabling as a stream: keyed state that survives restarts, and event-time timers."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators.disabling import Rule, State

#: State of timers and lists needs a store that can hold more than one value a key.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Disabling(StatefulProcessor):
    """Holds a key's events until the watermark has passed them, then takes them in order.

    A timer stands at each event that is held and at the time that a disabled key is due; one that fires takes all that
    the watermark has passed, so that a key's later timers of a batch find nothing left. State is the events not passed
    yet, the failures of the window and two times; a key that is enabled and has none of them has no state.
    """

    def __init__(self, rule: Rule, kind: str):
        self.rule, self.kind = rule, kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "event_id long, status string, us long")
        self.failed = handle.getListState("failed", "us long")
        self.times = handle.getValueState("times", "first long, disabled long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            new = list(zip(batch["event_id"].tolist(), batch["status"].tolist(), batch["us"].tolist(), strict=True))
            self.held.appendList(new)
            for ms in {us // 1000 for *_, us in new}:
                self.handle.registerTimer(ms)
        yield from ()

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()) * 1000 + 999
        held = sorted(self.held.get(), key=lambda x: (x[2], x[0])) if self.held.exists() else []
        state = self._state()
        found = []
        for event, status, us in held:
            if us <= passed:
                found += [(event, when, change) for when, change in state.step(self.rule, us, status)]
        found += [(None, when, change) for when, change in state.pass_time(self.rule, passed)]
        self._store(state, [x for x in held if x[2] > passed])
        if found:
            event, us, change = zip(*found, strict=True)
            yield pd.DataFrame({self.kind: [key[0]] * len(found), "event_id": pd.array(event, "Int64"), "us": us, "change": change})

    def _state(self) -> State:
        failed = deque(x[0] for x in self.failed.get()) if self.failed.exists() else deque()
        first, disabled = self.times.get() if self.times.exists() else (None, None)
        return State(failed, first, disabled)

    def _store(self, state: State, held: list) -> None:
        for place, values in ((self.held, held), (self.failed, [(us,) for us in state.failed])):
            if values:
                place.put(values)
            elif place.exists():
                place.clear()
        if state.first is None and state.disabled is None:
            self.times.clear()
        else:
            self.times.update((state.first, state.disabled))
        due = state.due(self.rule)
        if due is not None:
            self.handle.registerTimer(-(-due // 1000))

    def close(self) -> None:
        pass


def disable_changes(events: DataFrame, rule: Rule, key: str = "run", late: str = "10 minutes") -> DataFrame:
    """(key, event_id, ts, change) of a stream of events (key, event_id, status, ts) as they happen.

    Tells what ``runs.disable_changes`` tells of the same events, whatever the order in which they arrive within ``late``;
    later ones are dropped. A key is enabled by time as soon as the watermark says so, with no event to wait for: such a
    change has a null event_id. Needs the session's ``spark.sql.streaming.stateStore.providerClass`` to be STORE.
    """
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, "event_id", "status", "ts", F.unix_micros(F.col("ts")).alias("us")).withWatermark("ts", late)
    out = rows.groupBy(key).transformWithStateInPandas(Disabling(rule, key), f"`{key}` {kind}, event_id long, us long, change string", "Append", "EventTime")
    return out.select(key, "event_id", F.timestamp_micros("us").alias("ts"), "change")
