"""Detectors on keyed state with timers: what is silent now is told, not only what was.

Each source has a state: its last row that counts, and the rows that wait for the watermark.  A
row counts when the watermark has passed it, so rows that come late, but within the delay,
stand in their order; Spark drops those that come later than that.  A timer wakes a source when
the watermark passes its next waiting row, or the time by which it should have said something.

State and timers are Spark's, kept in its checkpoint: a query that is started anew goes on
with them.  A source is one key, and so one task in each micro-batch; where one source writes
more than a task can take in, the detectors of :mod:`live` deal its rows out, without timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import parse

#: State with timers is kept in this store only.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

FOUND = "source string, kind string, from_ms long, to_ms long, from_value string, to_value string"


#: Rows of a source that wait as one packed block, at least.  Changes no result.
BLOCK = 65_536
#: Rows that are told at once.
TOLD = 50_000

#: A block of waiting rows: times as whole numbers of 8 bytes, and for each the place of its value in ``names``, of 4 bytes.
WAITING = "ms binary, at binary, names array<string>"

Block = tuple[np.ndarray, np.ndarray, list[str]]


def _in_order(blocks: list[Block]) -> Block:
    """Blocks as one, in order of time and value."""
    names = sorted({n for b in blocks for n in b[2]})
    place = {n: k for k, n in enumerate(names)}
    ms = np.concatenate([np.zeros(0, np.int64), *(b[0] for b in blocks)])
    at = np.concatenate([np.zeros(0, np.int32), *(np.array([place[n] for n in b[2]], np.int32)[b[1]] for b in blocks if len(b[1]))])
    order = np.lexsort((at, ms))
    return ms[order], at[order], names


class InOrder(StatefulProcessor):
    """Rows ``(ms, value)`` of a source in order of time, each with its predecessor.

    Tells ``step`` rows: of two rows at least ``apart`` milliseconds apart (``changes``: of different value);
    and, with ``alarm``, an ``open`` row when the watermark passes a row by that much and nothing came.
    Rows wait in packed blocks, and are put in order and compared as arrays: a source's rows of a micro-batch are
    one task's, 12 bytes each beside their different values.
    """

    def __init__(self, apart: int, changes: bool, alarm: bool):
        self.apart, self.changes, self.alarm = apart, changes, alarm

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long, value string, told boolean")
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for batch in rows:
            batch = batch[batch["value"].notna()]
            if len(batch):
                at, names = pd.factorize(batch["value"])
                new.append((batch["ms"].to_numpy(np.int64), at.astype(np.int32), list(names)))
        yield from self._advance(key, timerValues, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, timerValues, [])

    def _wait(self, block: Block) -> None:
        ms, at, names = block
        for k in range(0, len(ms), BLOCK):
            used, here = np.unique(at[k : k + BLOCK], return_inverse=True)
            self.waiting.appendValue((ms[k : k + BLOCK].tobytes(), here.astype(np.int32).tobytes(), [names[n] for n in used]))

    def _advance(self, key, timerValues, new: list[Block]) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        old = [(np.frombuffer(r[0], np.int64), np.frombuffer(r[1], np.int32), list(r[2])) for r in self.waiting.get()]
        times, at, names = _in_order(old + new)
        ready = int(np.searchsorted(times, now, side="right"))
        last = self.last.get() if self.last.exists() else None
        ms, value, told = last if last else (None, None, False)
        if ready:
            yield from self._steps(key[0], times[:ready], at[:ready], names, ms, value)
            ms, value, told = int(times[ready - 1]), names[at[ready - 1]], False
        due = ms + self.apart if self.alarm and ms is not None and not told else None
        if due is not None and due <= now:
            yield _told(key[0], "open", [ms], [None], [value], [None])
            told, due = True, None
        if ready or told != (last[2] if last else False):
            self.last.update((ms, value, told))
        if ready:
            self.waiting.clear()
            self._wait((times[ready:], at[ready:], names))
        elif new:
            self._wait(_in_order(new))
        # one timer: the next time at which there is something to do
        wake = min([*(int(t) for t in times[ready : ready + 1]), *([due] if due is not None else [])], default=None)
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        if wake is not None:
            self.handle.registerTimer(wake)

    def _steps(self, source, ms: np.ndarray, at: np.ndarray, names: list[str], last_ms: int | None, last_value: str | None) -> Iterator[pd.DataFrame]:
        step = np.zeros(len(ms), bool)
        step[1:] = at[1:] != at[:-1] if self.changes else np.diff(ms) >= self.apart
        text = np.array(names, object)
        if last_ms is not None and (text[at[0]] != last_value if self.changes else ms[0] - last_ms >= self.apart):
            yield _told(source, "step", [last_ms], ms[:1], [last_value], text[at[:1]])
        found = np.flatnonzero(step)
        for k in range(0, len(found), TOLD):
            here = found[k : k + TOLD]
            yield _told(source, "step", ms[here - 1], ms[here], text[at[here - 1]], text[at[here]])


def _told(source, kind: str, from_ms, to_ms, from_value, to_value) -> pd.DataFrame:
    found = {"source": source, "kind": kind, "from_ms": pd.array(from_ms, "Int64"), "to_ms": pd.array(to_ms, "Int64"), "from_value": from_value, "to_value": to_value}
    return pd.DataFrame(found)


def _detect(rows: DataFrame, value: Column, apart_ms: int = 0, changes: bool = False, alarm: bool = False) -> DataFrame:
    """Rows ``(source, ts, ...)`` with a watermark on ``ts`` through :class:`InOrder`.

    Rows without a value only move the watermark.  They are not filtered out before: Spark would do so
    before it looks at the watermark, and then lines without a beat could never tell that one is overdue.
    """
    rows.sparkSession.conf.set(*STORE)
    given = rows.select("source", "ts", F.unix_millis("ts").alias("ms"), value.alias("value"))
    found = given.groupBy("source").transformWithStateInPandas(InOrder(apart_ms, changes, alarm), FOUND, "Append", "EventTime")
    return found.withColumn("from_ts", F.timestamp_millis("from_ms")).withColumn("to_ts", F.timestamp_millis("to_ms"))


def silences(lines: DataFrame, threshold: float = 30) -> DataFrame:
    """``(source, kind, from_ts, to_ts, gap_seconds)``: ``open`` when a source has said nothing for ``threshold`` seconds
    behind its last line, by the watermark; ``closed`` when a line ends such a silence."""
    found = _detect(lines, F.lit(""), int(threshold * 1000), alarm=True)
    kind = F.when(F.col("kind") == "step", "closed").otherwise("open")
    return found.select("source", kind.alias("kind"), "from_ts", "to_ts", ((F.col("to_ms") - F.col("from_ms")) / 1000).alias("gap_seconds"))


def changes(lines: DataFrame, field: str) -> DataFrame:
    """``(source, ts, from_value, to_value)``: changes of a field's value, in order of time."""
    value = parse.field("text", field)
    found = _detect(lines, value, changes=True)
    return found.select("source", F.col("to_ts").alias("ts"), "from_value", "to_value")


def heartbeats(lines: DataFrame, pattern: str, period: float, tolerance: float = 1.5) -> DataFrame:
    """``(source, kind, ts, interval, missing)``: ``late`` beats and how many are missing before each; ``silent`` when the next beat
    is overdue by the watermark, ``ts`` being the last beat's."""
    found = _detect(lines, F.when(F.contains("text", F.lit(pattern)), ""), int(period * tolerance * 1000), alarm=True)
    late = F.col("kind") == "step"
    seconds = (F.col("to_ms") - F.col("from_ms")) / 1000
    missing = F.greatest(F.lit(1).cast("long"), F.floor(seconds / period + 0.5).cast("long") - 1)
    return found.select("source", F.when(late, "late").otherwise("silent").alias("kind"), F.when(late, F.col("to_ts")).otherwise(F.col("from_ts")).alias("ts"), seconds.alias("interval"), F.when(late, missing).alias("missing"))
