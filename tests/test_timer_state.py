"""The timer detectors' state: rows wait in packed blocks, and stand in order however they came."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from tracewell.streaming import timers


class State:
    """A value or a list of Spark's state, and how many entries were written to it."""

    def __init__(self):
        self.kept, self.written = [], 0

    def _keep(self, values):
        self.kept += values
        self.written += len(values)

    def exists(self):
        return bool(self.kept)

    def get(self):
        return self.kept[0] if self.single else iter(list(self.kept))

    def clear(self):
        self.kept = []

    def update(self, value):
        self.kept = [value]

    def appendValue(self, value):
        self._keep([value])

    def appendList(self, values):
        self._keep(values)

    def put(self, values):
        self.kept = []
        self._keep(values)


class Handle:
    def __init__(self):
        self.states, self.timers = {}, set()

    def _state(self, name, single):
        self.states[name] = State()
        self.states[name].single = single
        return self.states[name]

    def getValueState(self, name, schema):
        return self._state(name, True)

    def getListState(self, name, schema):
        return self._state(name, False)

    def listTimers(self):
        return list(self.timers)

    def deleteTimer(self, t):
        self.timers.discard(t)

    def registerTimer(self, t):
        self.timers.add(t)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


@pytest.mark.parametrize("block", [7, 65_536])
def test_rows_wait_in_blocks_and_are_told_in_order(monkeypatch, block):
    monkeypatch.setattr(timers, "BLOCK", block, raising=False)
    monkeypatch.setattr(timers, "TOLD", 10, raising=False)
    rng = random.Random(9)
    rows = [(1000 + 20 * b + rng.randrange(40), rng.choice(["a", "b", "ü", None])) for b in range(10) for _ in range(100)]  # batches overlap by half
    given = sorted(r for r in rows if r[1] is not None)
    for apart, changes in ((0, True), (2, False)):
        handle, found = Handle(), []
        detector = timers.InOrder(apart, changes, alarm=False)
        detector.init(handle)
        for b in range(10):
            batch = pd.DataFrame(rows[100 * b : 100 * b + 100], columns=["ms", "value"])
            found += detector.handleInputRows(("s",), iter([batch[:33], batch[33:]]), At(1000 + 20 * b - 1))
            assert handle.timers
        found += detector.handleExpiredTimer(("s",), At(10_000), None)
        got = [tuple(r) for f in found for r in f.drop(columns=["source", "kind"]).itertuples(index=False)]
        steps = zip(given, given[1:], strict=False)
        assert got == [(a[0], b[0], a[1], b[1]) for a, b in steps if (a[1] != b[1] if changes else b[0] - a[0] >= apart)]
        assert all(len(f) <= 10 for f in found) and not handle.timers and not handle.states["waiting"].kept
        assert handle.states["waiting"].written <= 10 * (1 + 200 // block)
