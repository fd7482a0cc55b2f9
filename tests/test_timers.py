"""Timers of a key: one for what comes in a batch, and one for the first event that still waits when one has gone off."""

from __future__ import annotations

from pyspark.sql import Row

from attestry.streaming import ordered
from attestry.streaming.ledger import Order

SECOND = ordered.SECOND


class State(list):
    """A list or value of state, held in memory."""

    def get(self):
        return self[0] if len(self) == 1 and self.single else list(self)

    def exists(self):
        return bool(self)

    def put(self, rows):
        self[:] = rows

    appendList = list.extend

    def update(self, row):
        self[:] = [row]


class Handle:
    def __init__(self):
        self.timers = []

    def getListState(self, name, schema):
        return self._state(False)

    def getValueState(self, name, schema):
        return self._state(True)

    def _state(self, single):
        made = State()
        made.single = single
        return made

    def registerTimer(self, at):
        self.timers.append(at)


class Times:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_one_timer_for_a_batch_and_one_for_what_waits(spark):
    handle, names = Handle(), ["sequence", "at"]
    taken = ordered.InOrder(Order(10**15), names, ["key", "received", "sequence", "code"])
    taken.init(handle)
    rows = [Row(time=k * SECOND, sequence=9 - k, at=k) for k in (5, 1, 3, 2, 4)]
    assert list(taken.handleInputRows(("a",), iter(rows), None)) == [] and handle.timers == [1000]
    found = list(taken.handleExpiredTimer(("a",), Times(3000), None))
    assert [(r["sequence"], r["code"]) for r in found] == [(7, "event_order"), (6, "event_order")]
    assert 4000 in handle.timers[1:] and not {1000, 2000, 3000, 5000} & set(handle.timers[1:])
    assert [r["sequence"] for r in taken.handleExpiredTimer(("a",), Times(5000), None)] == [5, 4]
    assert list(taken.handleExpiredTimer(("a",), Times(6000), None)) == [] and list(taken.waiting) == []
