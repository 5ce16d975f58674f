"""Live logs: sources, windows and stateful detectors.

Stateless batch verbs (search, filters, redaction, parsing) take streaming DataFrames as
they are.  A detector looks at one micro-batch after the other (see ``run.detect``) and hands
on one row for each source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators.ordered import Scan
from .run import Detector


def read_stream_lines(spark: SparkSession, path: str, max_files: int = 10) -> DataFrame:
    """Appended text files as ``(source, arrived_at, text)``."""
    raw = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return raw.select(F.col("_metadata.file_path").alias("source"), F.current_timestamp().alias("arrived_at"), F.col("value").alias("text"))


def with_event_time(lines: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Lines that carry a time, with ``ts`` and a watermark."""
    ts = parse.parse_ts("text").cast("timestamp")
    return lines.withColumn("ts", ts).where("ts is not null").withWatermark("ts", delay)


def live_levels(lines: DataFrame, size: str = "1 minute") -> DataFrame:
    level = F.coalesce(parse.detect_level("text"), F.lit("other")).alias("level")
    return lines.groupBy(F.window("ts", size), level).agg(F.count(F.lit(1)).alias("lines"))


def live_crashes(lines: DataFrame) -> DataFrame:
    return lines.withColumn("keyword", parse.crash_keyword("text")).where("keyword is not null")


def live_density(lines: DataFrame, size: str = "1 minute", slide: str | None = None) -> DataFrame:
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return lines.groupBy(window, "source").agg(F.count(F.lit(1)).alias("lines"))


def union_streams(streams: dict[str, DataFrame]) -> DataFrame:
    """Several streams as one, each row with its origin."""
    out = None
    for name, s in streams.items():
        tagged = s.withColumn("origin", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


#: Lines of one source that lie within so many milliseconds make a chunk of an ordered scan.
CHUNK_MS = 3_600_000


def _after_the_last(rows: DataFrame, carry: DataFrame | None, columns: list[str], latest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (source, ms, text, …) of a micro-batch, each with its predecessor's ``columns`` as
    ``_prev`` (of the same source, in order of time and text; of the batches before for its first
    one), and each source's last row, which goes on to the next batch.

    The scan deals rows into chunks of time, so a batch is no single task, nor is a source.
    """
    kept = rows.select("source", "ms", "text", F.struct(*columns).alias("_here"), F.lit(1).alias("_new"))
    if carry is not None:  # what came before sorts first, whatever its time
        first = rows.groupBy("source").agg(F.min("ms").alias("_first"))
        old = carry.join(first, "source").select("source", F.least("ms", "_first").alias("ms"), F.lit("").alias("text"), "_here", F.lit(0).alias("_new"))
        kept = kept.unionByName(old)
    before = Scan(kept, order="ms", by=("source",), chunk=CHUNK_MS, tie=("_new", "text")).lag("_here", "_prev").where("_new = 1")
    last = rows.groupBy("source").agg(F.max_by(F.struct("ms", F.struct(*columns).alias("_here")), F.struct("ms", "text")).alias("l")).select("source", "l.*")
    if carry is not None and latest:
        last = last.unionByName(carry.select(*last.columns)).groupBy("source").agg(F.max_by(F.struct("ms", "_here"), "ms").alias("l")).select("source", "l.*")
    elif carry is not None:
        last = last.unionByName(carry.join(rows.select("source").distinct(), "source", "left_anti").select(*last.columns))
    return before, last


def _timed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ms", parse.epoch_ms("ts"))


def gap_detector(threshold: float = 30) -> Detector:
    """Silences of each source, across micro-batches: ``(source, from_ts, to_ts, gap_seconds)``."""

    def detect(rows: DataFrame, carry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        before, last = _after_the_last(_timed(rows), carry, ["ms"])
        ms, prev = F.col("_here.ms"), F.col("_prev.ms")
        gap = F.abs(ms - prev) / 1000
        found = before.where(gap >= threshold)
        return found.select("source", F.timestamp_millis(prev).alias("from_ts"), F.timestamp_millis(ms).alias("to_ts"), gap.alias("gap_seconds")), last

    return detect


def transition_detector(field: str) -> Detector:
    """Changes of a field's value in each source, across micro-batches."""

    def facts(rows: DataFrame) -> DataFrame:
        return _timed(rows).select("source", "ms", "text", parse.field("text", field).alias("_value"))

    def detect(rows: DataFrame, carry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        known = (rows if "_value" in rows.columns else facts(rows)).withColumnRenamed("_value", "value").where("value is not null")
        before, last = _after_the_last(known, carry, ["ms", "value"])
        found = before.where("_prev.value != _here.value")
        return found.select("source", F.timestamp_millis("_here.ms").alias("ts"), F.col("_prev.value").alias("from_value"), F.col("_here.value").alias("to_value")), last

    detect.facts = facts  # fields are read once, not for each scan of the batch
    return detect


def heartbeat_detector(pattern: str, period: float, tolerance: float = 1.5) -> Detector:
    """Heartbeats that come late by event time: how many are missing in each interval.  One that is
    older than its predecessor is not late."""

    def detect(rows: DataFrame, carry: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        beats = _timed(rows.where(F.contains("text", F.lit(pattern))))
        before, last = _after_the_last(beats, carry, ["ms"], latest=True)
        seconds = (F.col("_here.ms") - F.col("_prev.ms")) / 1000
        late = before.where(seconds >= period * tolerance)
        missing = F.greatest(F.lit(1).cast("long"), F.floor(seconds / period + 0.5).cast("long") - 1)
        return late.select("source", F.timestamp_millis("_here.ms").alias("ts"), seconds.alias("interval"), missing.alias("missing")), last

    return detect


def capture(lines: DataFrame, path: str, checkpoint: str):
    """Write a stream to Parquet as it comes; batch verbs read what is there."""
    return lines.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
