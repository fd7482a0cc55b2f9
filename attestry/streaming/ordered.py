"""Stateful rules over events in the order of their time, whatever the batches that they come in.

Events of a key wait in a list until the watermark has passed them: then none that belongs before them can still come. They are taken in the order of their time (ties by the rest of
the event), so what is found depends on the events alone and not on how the input is cut. Times are looked at in whole seconds of the watermark; an event of 10:00:00.2 is taken when
the watermark has reached 10:00:01. A key has one timer for what came in a batch, at its first event, and when a timer has gone off one for the first event that still waits: each event that waits has a timer at or before
its time, and every timer takes all that is due.

A rule keeps a small state for each key. It may have a deadline: if no event comes before it, the rule says so when the watermark passes it. State with a deadline at which the rule
forgets it is bounded by the keys that are active, and the list by the events of the lateness that is allowed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

SECOND = 1_000_000

#: Where Spark keeps the state of these rules.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule:
    """What is done with the events of a key. Times are microseconds since 1970."""

    #: Columns of an event behind its time, of the state, and of a result, as DDL.
    event: str
    state: str
    result: str

    def take(self, state: tuple | None, time: int, event: tuple) -> tuple[tuple | None, list[tuple]]:
        """The state after an event, and what is found (without the key)."""
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        """When the rule has something to say if no event comes before."""
        return None

    def expired(self, state: tuple, time: int) -> tuple[tuple | None, list[tuple]]:
        """The state after its deadline, which no longer has it, and what is found."""
        return None, []


def up(time: int) -> int:
    """The whole second, in milliseconds, at or after a time."""
    return -(-time // SECOND) * 1000


def run(rule: Rule, state: tuple | None, events: list[tuple], now: int) -> tuple[tuple | None, list[tuple]]:
    """Takes events (time and event) that are in order, with the deadlines before and after them, until now."""
    found: list[tuple] = []

    def expire(until: int) -> None:
        nonlocal state
        while state is not None and (at := rule.deadline(state)) is not None and up(at) * 1000 <= until:
            state, more = rule.expired(state, at)
            found.extend(more)

    for time, event in events:
        expire(time)
        state, more = rule.take(state, time, event)
        found.extend(more)
    expire(now)
    return state, found


def order_of(row: tuple) -> tuple:
    """Nulls first, then by value."""
    return tuple((x is not None, x if x is not None else 0) for x in row)


class InOrder(StatefulProcessor):
    def __init__(self, rule: Rule, names: list[str], results: list[str]):
        self.rule, self.names, self.results = rule, names, results
        self.schemas = StructType.fromDDL(f"time long, {rule.event}"), StructType.fromDDL(rule.state)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.schemas[0])
        self.state = handle.getValueState("state", self.schemas[1])

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        events = [(row["time"], *(row[name] for name in self.names)) for row in rows]
        self.handle.registerTimer(min(up(event[0]) for event in events))
        self.waiting.appendList(events)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs() // 1000 * 1000
        waiting = [tuple(row) for row in self.waiting.get()]
        due = sorted((row for row in waiting if up(row[0]) <= now), key=order_of)
        state = tuple(self.state.get()) if self.state.exists() else None
        after, found = run(self.rule, state, [(row[0], row[1:]) for row in due], now * 1000)
        if due:
            rest = [row for row in waiting if up(row[0]) > now]
            self.waiting.put(rest) if rest else self.waiting.clear()
        else:
            rest = waiting
        if rest:
            self.handle.registerTimer(min(up(row[0]) for row in rest))
        if after is None:
            self.state.clear()
        elif after != state:
            self.state.update(after)
        if after is not None and (at := self.rule.deadline(after)) is not None:
            self.handle.registerTimer(up(at))
        for row in found:
            yield Row(**dict(zip(self.results, (*key, *row), strict=True)))

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, rule: Rule, keys: list[str], time: str, lateness: str) -> DataFrame:
    """rows: a stream with keys, a time and the columns of the rule's events. What the rule finds, with the keys. Events that come more than the lateness behind are dropped by Spark."""
    names = StructType.fromDDL(rule.event).names
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    results = f"{', '.join(f'{k} {kinds[k]}' for k in keys)}, {rule.result}"
    timed = rows.withWatermark(time, lateness).select(*keys, F.col(time).alias("event_time"), F.unix_micros(F.col(time)).alias("time"), *names)
    processor = InOrder(rule, names, StructType.fromDDL(results).names)
    return timed.groupBy(*keys).transformWithState(statefulProcessor=processor, outputStructType=results, outputMode="Append", timeMode="EventTime")
