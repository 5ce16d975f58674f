"""The same answers however the log is dealt out, and reading files line by line."""

from __future__ import annotations

import os
import random

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import sequence
from tracewell.operators.ordered import Scan
from tracewell.sources import readers
from tracewell.streaming import live, run


@pytest.mark.parametrize("split", [4096, 1 << 20])
def test_line_numbers_over_splits_and_crlf(spark, tmp_path, split):
    rng = random.Random(1)
    want = {}
    for name, end in (("a.log", "\n"), ("b.log", "\r\n")):
        texts = [f"{k} " + "x" * rng.randrange(60) for k in range(1500)]
        (tmp_path / name).write_bytes(end.join(texts).encode())
        want[name] = texts
    (tmp_path / "empty.log").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = readers.read_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3000
    assert all(want[r.file.rsplit("/", 1)[1]][r.line_no] == r.text for r in got)


@pytest.mark.parametrize("parts", [1, 4, 64])
@pytest.mark.parametrize("chunk", [1, 7, 64, 100_000])
def test_ordered_scans_match_plain_python(spark, parts, chunk):
    rng = random.Random(2)
    rows = [(f, n, rng.choice([None, None, 1, 2, 3])) for f in "ab" for n in sorted(rng.sample(range(400), 60))]
    df = spark.createDataFrame(rows, "file string, line_no long, v long").repartition(parts)
    scan = lambda d: Scan(d, chunk=chunk)
    out = scan(scan(scan(scan(scan(df).lag("v", "lag")).last_known("v", "last")).next_known("v", "next")).number("n")).running_max("v", "top")
    got = {(r.file, r.line_no): r for r in out.collect()}
    for f in "ab":
        mine = [(n, v) for g, n, v in rows if g == f]
        for k, (n, _) in enumerate(mine):
            seen, ahead = [v for _, v in mine[: k + 1] if v is not None], [v for _, v in mine[k:] if v is not None]
            r = got[f, n]
            assert (r.lag, r.last, r.next, r.n, r.top) == (
                mine[k - 1][1] if k else None, seen[-1] if seen else None, ahead[0] if ahead else None, k, max(seen) if seen else None
            )


def test_table_streams_read_files_and_folders_whole(spark, tmp_path):
    rows = spark.range(100).withColumn("day", F.col("id") % 3)
    rows.repartition(4).write.parquet(str(tmp_path / "parts.parquet"))
    rows.write.partitionBy("day").parquet(str(tmp_path / "days.parquet"))
    rows.coalesce(1).write.parquet(str(tmp_path / "written"))
    next((tmp_path / "written").glob("part-*.parquet")).rename(tmp_path / "one.parquet")
    want = sorted((k, k % 3) for k in range(100))
    for table in ("parts", "days", "one"):
        got = run.finish(run.table_stream(spark, str(tmp_path), table), table)
        assert sorted((r.id, r.day) for r in got.collect()) == want, table


def test_streams_give_what_batches_give(spark, tmp_path):
    files = [["2024-01-01 10:00:00 INFO mode=a", "2024-01-01 10:00:10 ERROR mode=a"], ["2024-01-01 10:05:00 INFO mode=b", "2024-01-01 10:05:01 FATAL panic mode=b"]]
    folder = tmp_path / "in"
    folder.mkdir()
    for k, texts in enumerate(files):
        (folder / f"{k}.log").write_text("\n".join(texts))
        os.utime(folder / f"{k}.log", (1_700_000_000 + k, 1_700_000_000 + k))
    src = live.with_event_time(live.read_stream_lines(spark, str(folder), 1)).withColumn("source", F.lit("s"))
    found = {n: run.detect(src, d, n).collect() for n, d in {"gaps": live.gap_detector(30), "flips": live.transition_detector("mode"), "beats": live.heartbeat_detector("mode=", 10)}.items()}
    assert [r.gap_seconds for r in found["gaps"]] == [290.0]
    assert [(r.from_value, r.to_value) for r in found["flips"]] == [("a", "b")]
    assert [r.missing for r in found["beats"]] == [28]
    crashes = live.live_crashes(src).select("keyword").writeStream.format("memory").queryName("t_crashes").outputMode("append").start()
    levels = live.live_levels(src).writeStream.format("memory").queryName("t_levels").outputMode("complete").start()
    for q in (crashes, levels):
        q.processAllAvailable()
        q.stop()
    assert [r.keyword for r in spark.table("t_crashes").collect()] == ["fatal"]
    assert {r.level: r.lines for r in spark.table("t_levels").groupBy("level").agg(F.sum("lines").alias("lines")).collect()} == {"info": 2, "error": 1, "fatal": 1}
    batch = spark.createDataFrame([("s", k, t) for k, t in enumerate(sum(files, []))], "file string, line_no long, text string")
    assert [r.gap_seconds for r in sequence.time_gaps(batch).collect()] == [290.0]


def test_detectors_hand_on_the_last_row_of_each_source(spark, monkeypatch):
    monkeypatch.setattr(live, "CHUNK_MS", 7_000)
    rng = random.Random(4)
    at = sorted(rng.sample(range(100_000), 200))
    rows = [(f"h{rng.randrange(3)}", f"beat mode={rng.choice('ab')}", 1_700_000_000_000 + 1000 * t) for t in at]
    table = spark.createDataFrame(rows, "source string, text string, at long").withColumn("ts", F.timestamp_millis("at")).withColumn("at", F.col("at").cast("double"))
    want_gaps, want_flips, want_beats, last = [], [], [], {}
    for source, text, ms in rows:
        if source in last:
            gap, mode = (ms - last[source][0]) / 1000, last[source][1]
            want_gaps += [(source, gap)] if gap >= 900 else []
            want_flips += [(source, mode, text[-1])] if mode != text[-1] else []
            want_beats += [(source, max(1, int(gap / 300 + 0.5) - 1))] if gap >= 450 else []
        last[source] = (ms, text[-1])
    for times in (1, 6):
        found = lambda d: run.detect(run.arrive(table, "at", times, "rows").drop("at"), d, "found").collect()  # noqa: B023, E731
        assert sorted((r.source, r.gap_seconds) for r in found(live.gap_detector(900))) == sorted(want_gaps)
        assert sorted((r.source, r.from_value, r.to_value) for r in found(live.transition_detector("mode"))) == sorted(want_flips)
        assert sorted((r.source, r.missing) for r in found(live.heartbeat_detector("beat", 300))) == sorted(want_beats)
    assert run.detect(run.arrive(table.limit(0), "at", 1, "none").drop("at"), live.gap_detector(), "none").count() == 0
