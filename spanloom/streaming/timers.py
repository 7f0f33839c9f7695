"""State with event-time timers: rows of a key wait until the watermark has passed them, leave in order, and state that is idle for long goes.

Batches may bring a key's rows in any order; a machine that reads them as they come would see them out of order. Here rows are
held by key until no earlier one can come, then a timer releases them by time and id, whatever batch they came in.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from ..operators.online import Ewma

#: Timers need this state store.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.UTC)


def micros(t: pd.Timestamp | dt.datetime) -> int:
    """Microseconds since 1970; a time without zone is UTC."""
    at = pd.Timestamp(t)
    return (at.tz_localize("UTC") if at.tzinfo is None else at.tz_convert("UTC")).value // 1000


class OrderedLevels(StatefulProcessor):
    """Running levels over each key's rows in the order of time and id, released by timers; the level of a key without rows for ``idle_ms`` is forgotten.

    State of a key: its waiting rows as a list, its level, when its last row was, and when it wakes next. Rows of a batch are added in one call and those that wait on are put back in one, as
    every call goes to the state store and back; of rows with the same time and id the last one counts.
    """

    def __init__(self, key: str, row_id: str, delta: str, idle_ms: int):
        self.key, self.row_id, self.delta, self.idle_ms = key, row_id, delta, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id bigint, delta double")
        self.level = handle.getValueState("level", "level double, spread double, seen int")
        self.last = handle.getValueState("last", "at bigint")
        self.next = handle.getValueState("next", "ms bigint")

    def wake(self, ms: int) -> None:
        """One timer at a time: for the earliest row that waits."""
        due = self.next.get()
        if due is None or ms < due[0]:
            self.handle.registerTimer(ms)
            self.next.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.last.get()
        newest, earliest, added = None if before is None else before[0], None, []
        for part in rows:
            for at, i, d in zip(part["ts"], part[self.row_id], part[self.delta], strict=True):
                when = micros(at)
                added.append((when, int(i), 0.0 if pd.isna(d) else float(d)))
                newest = when if newest is None else max(newest, when)
                earliest = when if earliest is None else min(earliest, when)
        if added:
            self.waiting.appendList(added)
        if earliest is not None:
            self.wake(-(-earliest // 1000))
            self.last.update((newest,))
            self.handle.registerTimer(-(-newest // 1000) + self.idle_ms)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((*row, d) for row, d in {(at, i): d for at, i, d in self.waiting.get()}.items())
        ready = [row for row in held if row[0] <= until]
        out = []
        if ready:
            before = self.level.get()
            state = Ewma() if before is None else Ewma(*before)
            out = [(key[0], i, state.push(d)) for _, i, d in ready]
            self.level.update((state.level, state.spread, state.seen))
            if len(ready) < len(held):
                self.waiting.put(held[len(ready) :])
            else:
                self.waiting.clear()
        self.next.clear()
        if len(ready) < len(held):
            self.wake(-(-held[len(ready)][0] // 1000))
        elif (last := self.last.get()) is not None and last[0] + self.idle_ms * 1000 <= until:
            self.level.clear()
            self.last.clear()
        if out:
            yield pd.DataFrame(out, columns=[self.key, "id", "spike"])

    def close(self) -> None:
        pass


def ordered_ewma(events: DataFrame, key: str, row_id: str, delta: str, watermark: str = "1 hour", idle_ms: int = 7 * 86_400_000) -> DataFrame:
    """key, id, spike of the rows that the watermark has passed, as the batch form gives them whatever order batches bring them in. Later rows wait; rows behind the watermark are dropped."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(key, row_id, "ts", delta).withWatermark("ts", watermark)
    return rows.groupBy(key).transformWithStateInPandas(OrderedLevels(key, row_id, delta, idle_ms), f"{key} {kind}, id long, spike double", "append", "eventtime")
