"""The driver's tables seen as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts
from .store import store_once

LEVEL_OF = {"error": "ERROR", "signup": "WARN", "purchase": "INFO", "click": "DEBUG", "view": "TRACE"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as one file of log lines, the event's number as line number; the log is stored
    in the shared folder when it is first asked for, as a log that was taken in."""
    source = f"{sf_dir}/events.parquet"
    return store_once(spark, source, "event-log", lambda: event_lines(table(spark, sf_dir, "events")))


def parsed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log with the facts that several verbs share, stored like it."""
    source = f"{sf_dir}/events.parquet"
    return store_once(spark, source, "parsed-log", lambda: facts.with_facts(event_log(spark, sf_dir)))


def event_lines(events: DataFrame) -> DataFrame:
    """Events, of a table or a stream, as log lines.

    Errors with k ending in 0 or 1 carry a panic or an exception, so that there are crashes.
    """
    level = F.coalesce(*[F.when(F.col("event_type") == e, v) for e, v in LEVEL_OF.items()])
    k = F.get_json_object("props", "$.k")
    crash = F.when(F.col("event_type") == "error", F.when(k.cast("int") % 10 == 0, " panic: out of memory").when(k.cast("int") % 10 == 1, " unhandled exception"))
    text = F.concat(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" "), level, F.lit(" [svc-"), (F.col("user_id") % 8).cast("string"), F.lit("] event="), F.col("event_type"),
        F.lit(" user_id="), F.col("user_id").cast("string"), F.format_string(" value=%.2f", "value"), F.lit(" k="), k, F.coalesce(crash, F.lit("")),
    )
    return events.select(F.lit("events").alias("file"), F.col("event_id").alias("line_no"), text.alias("text"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a file of lines."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("file"), F.posexplode(F.split("text", "\n")).alias("line_no", "text")
    ).withColumn("line_no", F.col("line_no").cast("long"))


#: The same two views for the SQL twins, with what the lines are made of beside the text.
L = r"""
WITH L0 AS (
  SELECT *, date_trunc('milliseconds', ts) AS t, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE 'TRACE' END AS word FROM events
), L AS (
  SELECT 'events' AS file, event_id AS line_no, t AS ts, epoch_ms(t) AS ms, 'svc-' || (user_id % 8) AS component, event_type AS event, user_id, k,
    CAST(printf('%.2f', value) AS DOUBLE) AS value,
    CASE WHEN event_type = 'error' AND k % 10 = 0 THEN 'panic' WHEN event_type = 'error' AND k % 10 = 1 THEN 'unhandled' END AS crash,
    CASE WHEN event_type = 'error' AND k % 10 = 0 THEN 'fatal' WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'warning'
      WHEN event_type = 'purchase' THEN 'info' WHEN event_type = 'click' THEN 'debug' ELSE 'trace' END AS level,
    strftime(t, '%Y-%m-%d %H:%M:%S.%g') || ' ' || word || ' [svc-' || (user_id % 8) || '] event=' || event_type || ' user_id=' || user_id
      || ' value=' || printf('%.2f', value) || ' k=' || k
      || CASE WHEN event_type = 'error' AND k % 10 = 0 THEN ' panic: out of memory' WHEN event_type = 'error' AND k % 10 = 1 THEN ' unhandled exception' ELSE '' END AS text
  FROM L0
)
"""
D = r"""
WITH D0 AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
D AS (SELECT 'doc-' || doc_id AS file, CAST(i - 1 AS BIGINT) AS line_no, parts[i] AS text FROM D0, unnest(range(1, len(parts) + 1)) AS t(i))
"""
