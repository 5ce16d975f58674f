"""Detectors with timers: open silences, late rows, and restarts."""

from __future__ import annotations

import datetime

import pytest

from tracewell.streaming import live, timers

SCHEMA = "source string, text string"


def line(second: int, rest: str = "x") -> str:
    return f"{datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=second)} INFO {rest}"


def at(ts: datetime.datetime | None) -> int | None:
    return None if ts is None else int((ts - datetime.datetime(2024, 1, 1)).total_seconds())


class Feed:
    """Batches of lines given to a detector one after the other, each with a query of its own:
    every batch but the first is a restart from the checkpoint."""

    def __init__(self, spark, tmp_path, detector):
        self.spark, self.path, self.detector, self.n = spark, tmp_path, detector, 0
        (tmp_path / "in").mkdir()

    def give(self, rows: list[tuple[str, str]]) -> list[tuple]:
        if rows:
            self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        stream = self.spark.readStream.schema(SCHEMA).parquet(str(self.path / "in"))
        found = self.detector(live.with_event_time(stream, "10 seconds"))
        q = found.writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "state")).trigger(availableNow=True).start()
        q.awaitTermination()
        out = self.spark.read.schema(found.schema).parquet(str(self.path / "out")).collect()
        return sorted((tuple(at(v) if isinstance(v, datetime.datetime) else v for v in r) for r in out), key=str)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_silences_open_by_timer_close_by_lines_and_late_rows(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda lines: timers.silences(lines, 30))
    assert feed.give([("a", line(0)), ("a", line(5)), ("b", line(3))]) == []
    # b goes on; the watermark (70 - 10) passes a's last line by 30 seconds: told without a line of a
    found = feed.give([("b", line(20)), ("b", line(40)), ("b", line(70))])
    assert found == [("a", "open", 5, None, None)]
    # a's row of second 50 is behind the watermark and does not count; b's of 65 comes late but in time
    found = feed.give([("a", line(50)), ("b", line(65)), ("b", line(110))])
    assert ("b", "open", 70, None, None) in found and not any(r[0] == "a" and r[1] == "closed" for r in found)
    found = feed.give([("a", line(120)), ("b", line(160))])
    told = [("a", "closed", 5, 120, 115.0), ("a", "open", 120, None, None), ("a", "open", 5, None, None), ("b", "closed", 70, 110, 40.0), ("b", "open", 110, None, None), ("b", "open", 70, None, None)]
    assert found == told


def test_changes_stand_in_order_of_time(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda lines: timers.changes(lines, "mode"))
    feed.give([("a", line(5, "mode=x")), ("a", line(9, "mode=y")), ("a", line(7, "mode=x"))])
    feed.give([("a", line(6, "mode=z")), ("a", line(8, "nothing")), ("b", line(30, "mode=q"))])
    found = feed.give([("b", line(60, "mode=q"))])
    assert found == [("a", 6, "x", "z"), ("a", 7, "z", "x"), ("a", 9, "x", "y")]


def test_a_beat_that_never_comes_again_is_told(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda lines: timers.heartbeats(lines, "beat", 10))
    feed.give([("a", line(0, "beat")), ("a", line(10, "beat")), ("a", line(41, "beat")), ("a", line(42, "other"))])
    found = feed.give([("b", line(100, "no b e a t"))])
    assert found == [("a", "late", 41, 31.0, 2), ("a", "silent", 10, None, None), ("a", "silent", 41, None, None)]


def test_a_stream_of_nothing(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda lines: timers.silences(lines, 30))
    assert feed.give([("a", "no time here")]) == []
