"""Queries of files and streams: written, then read as a live log would be."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import search
from ..sources import intake, readers, sinks
from ..sources.views import L, event_log, event_lines
from ..streaming import live, run, timers
from .base import query


def stream(spark, sf):
    return live.with_event_time(event_lines(run.table_stream(spark, sf, "events")).withColumnRenamed("file", "source"))


@query("s1_read_lines", L + "SELECT 'part=' || (line_no // 700 + 1) AS folder, line_no % 700 AS line_no, text FROM L")
def s1(spark, sf):
    path = run.scratch(spark, "lines")
    parts = sinks.split_output(event_log(spark, sf), "lines", 700)
    parts.repartition("part").sortWithinPartitions("part", "line_no").select("part", "text").write.partitionBy("part").text(path)
    read = readers.read_lines(spark, path)
    return read.select(F.regexp_extract("file", r"(part=\d+)", 1).alias("folder"), "line_no", "text")


@query("s6_read_folder", L + "SELECT count(*) AS lines, count(DISTINCT line_no // 700) AS files FROM L")
def s6(spark, sf):
    path = run.scratch(spark, "folder")
    parts = sinks.split_output(event_log(spark, sf), "lines", 700)
    parts.repartition("part").select("part", "text").write.partitionBy("part").text(path)
    return readers.read_folder(spark, path).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("file").alias("files"))


@query("s10_incremental_intake", L + "SELECT 'part=' || (line_no // 700 + 1) AS folder, level, count(*) AS lines, min(line_no % 700) AS first_line FROM L GROUP BY ALL")
def s10(spark, sf):
    """The log comes in three loads of files; each run takes in what is new."""
    path, root = run.scratch(spark, "growing"), run.scratch(spark, "taken-in")
    parts = sinks.split_output(event_log(spark, sf), "lines", 700)
    for k in range(3):
        parts.where(F.col("part") % 3 == k).repartition("part").sortWithinPartitions("part", "line_no").select("part", "text").write.mode("append").partitionBy("part").text(path)
        intake.take_in(spark, path, root)
    lines = intake.taken_in(spark, root)
    return lines.groupBy(F.regexp_extract("file", r"(part=\d+)", 1).alias("folder"), F.col("_level").alias("level")).agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"))


@query("t2_live_levels", L + "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, level, count(*) AS lines FROM L GROUP BY ALL")
def t2(spark, sf):
    rows = run.finish_complete(live.live_levels(stream(spark, sf), "1 hour"), "levels")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "level", "lines")


@query("t3_live_density", L + "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, file AS source, count(*) AS lines FROM L GROUP BY ALL")
def t3(spark, sf):
    rows = run.finish_complete(live.live_density(stream(spark, sf), "1 day"), "density")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "source", "lines")


def arrivals(spark, sf, times: int = 5):
    """The event log of four hosts as a stream: its lines arrive in order of time, in several
    micro-batches, and each batch holds lines of all hosts."""
    lines = event_log(spark, sf)
    host = F.concat(F.lit("host"), F.regexp_extract("text", r"user_id=(\d+)", 1).cast("long") % 4)
    rows = lines.select(host.alias("source"), "text", F.unix_millis(parse.parse_ts("text").cast("timestamp")).cast("double").alias("at"))
    return live.with_event_time(run.arrive(rows, "at", times, "arrivals").drop("at"))


HOSTS = L + ", S AS (SELECT 'host' || (user_id % 4) AS source, * FROM L) "


@query("t1_stream_lines", L + "SELECT count(*) AS lines, count(DISTINCT line_no // 700) AS sources, min(text) AS least, max(text) AS greatest FROM L")
def t1(spark, sf):
    path = run.scratch(spark, "appended")
    parts = sinks.split_output(event_log(spark, sf), "lines", 700)
    parts.repartition("part").select("part", "text").write.partitionBy("part").text(path)
    seen = run.finish(live.read_stream_lines(spark, path + "/*", 100).select("source", "text", "arrived_at"), "seen")
    return seen.where("arrived_at is not null").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("source").alias("sources"), F.min("text").alias("least"), F.max("text").alias("greatest"))


@query("t4_live_gaps", HOSTS + ", G AS (SELECT source, lag(ts) OVER w AS from_ts, ts AS to_ts, abs(ms - lag(ms) OVER w) / 1000.0 AS gap_seconds FROM S WINDOW w AS (PARTITION BY source ORDER BY ms, text)) SELECT * FROM G WHERE gap_seconds >= 600")
def t4(spark, sf):
    rows = run.detect(arrivals(spark, sf), live.gap_detector(600), "gaps")
    return rows.select("source", F.col("from_ts").cast("timestamp_ntz").alias("from_ts"), F.col("to_ts").cast("timestamp_ntz").alias("to_ts"), "gap_seconds")


@query("t5_live_transitions", HOSTS + ", R AS (SELECT source, ts, lag(event) OVER w AS from_value, event AS to_value FROM S WINDOW w AS (PARTITION BY source ORDER BY ms, text)) SELECT * FROM R WHERE from_value <> to_value")
def t5(spark, sf):
    rows = run.detect(arrivals(spark, sf), live.transition_detector("event"), "flips")
    return rows.select("source", F.col("ts").cast("timestamp_ntz").alias("ts"), "from_value", "to_value")


@query("t6_live_heartbeat", HOSTS + ", R AS (SELECT source, ts, (ms - lag(ms) OVER w) / 1000.0 AS d FROM S WHERE event = 'purchase' WINDOW w AS (PARTITION BY source ORDER BY ms, text)) SELECT source, ts, d AS interval, greatest(1, CAST(floor(d / 1200 + 0.5) AS BIGINT) - 1) AS missing FROM R WHERE d >= 1800")
def t6(spark, sf):
    rows = run.detect(arrivals(spark, sf), live.heartbeat_detector("event=purchase", 1200), "beats")
    return rows.select("source", F.col("ts").cast("timestamp_ntz").alias("ts"), "interval", "missing")


#: What the watermark has passed when the stream ends: a minute behind the last line.
CLOSED = HOSTS + ", C AS (SELECT * FROM S WHERE ms <= (SELECT max(ms) - 60000 FROM S)) "


def still_open(rows, key: str, opened: str, closed: str):
    """Without what was open for a while: an open row stays only if no later line closed it."""
    ends = rows.where(F.col("kind") == closed).select("source", F.col(key).alias("_from"))
    same = (rows["source"] == ends["source"]) & (rows[key] == ends["_from"]) & (rows["kind"] == opened)
    return rows.join(ends, same, "left_anti")


@query("t4_silences_by_timer", CLOSED + """, G AS (SELECT source, 'closed' AS kind, lag(ts) OVER w AS from_ts, ts AS to_ts, (ms - lag(ms) OVER w) / 1000.0 AS gap_seconds FROM C WINDOW w AS (PARTITION BY source ORDER BY ms, event))
SELECT * FROM G WHERE gap_seconds >= 1200 UNION ALL SELECT source, 'open', max(ts), NULL, NULL FROM C GROUP BY source HAVING max(ms) + 1200000 <= (SELECT max(ms) - 60000 FROM S)""")
def t4_timer(spark, sf):
    rows = run.finish(timers.silences(arrivals(spark, sf), 1200), "silences")
    rows = still_open(rows, "from_ts", "open", "closed")
    return rows.select("source", "kind", F.col("from_ts").cast("timestamp_ntz").alias("from_ts"), F.col("to_ts").cast("timestamp_ntz").alias("to_ts"), "gap_seconds")


@query("t5_changes_by_timer", CLOSED + ", R AS (SELECT source, ts, lag(event) OVER w AS from_value, event AS to_value FROM C WINDOW w AS (PARTITION BY source ORDER BY ms, event)) SELECT * FROM R WHERE from_value <> to_value")
def t5_timer(spark, sf):
    rows = run.finish(timers.changes(arrivals(spark, sf), "event"), "changes")
    return rows.select("source", F.col("ts").cast("timestamp_ntz").alias("ts"), "from_value", "to_value")


@query("t6_beats_by_timer", HOSTS + """, C AS (SELECT * FROM S WHERE event = 'purchase' AND ms <= (SELECT max(ms) - 60000 FROM S)),
R AS (SELECT source, ts, (ms - lag(ms) OVER w) / 1000.0 AS d FROM C WINDOW w AS (PARTITION BY source ORDER BY ms))
SELECT source, 'late' AS kind, ts, d AS interval, greatest(1, CAST(floor(d / 1200 + 0.5) AS BIGINT) - 1) AS missing FROM R WHERE d >= 1800
UNION ALL SELECT source, 'silent', max(ts), NULL, NULL FROM C GROUP BY source HAVING max(ms) + 1800000 <= (SELECT max(ms) - 60000 FROM S)""")
def t6_timer(spark, sf):
    rows = run.finish(timers.heartbeats(arrivals(spark, sf), "event=purchase", 1200), "beats")
    last = rows.where("kind = 'late'").groupBy("source").agg(F.max("ts").alias("_last"))
    rows = rows.join(last, "source", "left").where("kind = 'late' or _last is null or ts >= _last")
    return rows.select("source", "kind", F.col("ts").cast("timestamp_ntz").alias("ts"), "interval", "missing")


@query("t2_live_crashes", HOSTS + "SELECT source, ts, text, crash AS keyword FROM S WHERE crash IS NOT NULL")
def t2_crashes(spark, sf):
    rows = run.finish(live.live_crashes(arrivals(spark, sf)), "crashes")
    return rows.select("source", F.col("ts").cast("timestamp_ntz").alias("ts"), "text", "keyword")


@query("t8_capture", HOSTS + "SELECT source, level, count(*) AS lines FROM S GROUP BY ALL")
def t8(spark, sf):
    """A stream saved as it comes; then a batch verb over what was saved."""
    path = run.scratch(spark, "captured")
    live.capture(arrivals(spark, sf), path, run.scratch(spark, "captured-state")).trigger(availableNow=True).start().awaitTermination()
    saved = spark.read.parquet(path)
    return saved.groupBy("source", parse.detect_level("text").alias("level")).agg(F.count(F.lit(1)).alias("lines"))


@query("t7_live_search", L + "SELECT line_no, CAST(strpos(text, 'panic') - 1 AS INTEGER) AS \"column\" FROM L WHERE crash = 'panic'")
def t7(spark, sf):
    lines = event_lines(run.table_stream(spark, sf, "events"))
    return run.finish(search.search(lines.withColumn("text", parse.redact_hashed("text")), "panic").select("line_no", "column"), "hits")


@query("t9_live_union", L + "SELECT 'errors' AS origin, line_no FROM L WHERE event = 'error' UNION ALL SELECT 'signups', line_no FROM L WHERE event = 'signup'")
def t9(spark, sf):
    lines = event_lines(run.table_stream(spark, sf, "events"))
    both = {"errors": lines.where(F.contains("text", F.lit("event=error"))), "signups": lines.where(F.contains("text", F.lit("event=signup")))}
    return run.finish(live.union_streams(both).select("origin", "line_no"), "union")
