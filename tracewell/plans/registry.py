"""All queries of the log verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import profile, proximity, sequence
from ..sources.views import event_log
from . import log_queries, more_queries, stream_queries  # noqa: F401  they register themselves
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of at least ten minutes, what failed within twenty lines of each."""
    lines = event_log(spark, sf_dir)
    gaps = sequence.time_gaps(lines, 600).select("file", "line_no", "gap_seconds")
    failed = profile.analysed(lines).where("level in ('error', 'fatal')").select("file", F.col("line_no").alias("other_line_no"), "component")
    near = proximity.near_join(gaps, failed, 20)
    return near.groupBy("file", "line_no", "gap_seconds").agg(F.array_join(F.array_sort(F.collect_set("component")), ",").alias("failing"))
