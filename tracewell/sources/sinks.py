"""Writers: extracts, ranges, numbered parts, merged timelines, marks and baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse


def extract(lines: DataFrame, numbered: bool = True) -> DataFrame:
    """Lines as text to write, with the viewer's line number (from 1) before a tab."""
    text = F.concat_ws("\t", (F.col("line_no") + 1).cast("string"), "text") if numbered else F.col("text")
    return lines.select("file", "line_no", text.alias("value"))


def save_range(lines: DataFrame, start: int, end: int, delimiter: str | None = None, visible: list[bool] | None = None) -> DataFrame:
    """Lines start..end, optionally without hidden columns."""
    some = lines.where(F.col("line_no").between(start, end))
    text = parse.project_columns("text", delimiter, visible) if delimiter and visible else F.col("text")
    return some.select("file", "line_no", text.alias("value"))


def split_output(lines: DataFrame, mode: str, value: int) -> DataFrame:
    """Part number of each line: ``lines`` gives parts of so many lines, ``parts`` so many parts."""
    if mode == "lines":
        return lines.withColumn("part", (F.floor(F.col("line_no") / value) + 1).cast("long"))
    sizes = lines.groupBy("file").agg((F.max("line_no") + 1).alias("_n"))
    each = F.ceil(F.col("_n") / value)
    return lines.join(sizes, "file").withColumn("part", (F.floor(F.col("line_no") / each) + 1).cast("long")).drop("_n")


def part_names(parts: DataFrame, stem: str, ext: str) -> DataFrame:
    """A row for each part with its file name and the names before and behind it."""
    name = lambda p: F.concat(F.lit(stem + "_part"), p.cast("string"), F.lit(ext))
    some = parts.groupBy("file", "part").agg(F.count(F.lit(1)).alias("lines"))
    last = some.groupBy("file").agg(F.max("part").alias("total"))
    p = F.col("part")
    return some.join(last, "file").select(
        "file", "part", "lines", "total", name(p).alias("name"), F.when(p > 1, name(p - 1)).alias("prev"), F.when(p < F.col("total"), name(p + 1)).alias("next")
    )


def write_parts(lines: DataFrame, path: str, mode: str, value: int) -> None:
    parts = split_output(lines, mode, value)
    parts.select("part", "text").write.partitionBy("part").mode("overwrite").text(path)


def timeline_text(merged: DataFrame) -> DataFrame:
    """``ts | origin | line`` of a merged timeline, in its order."""
    return merged.orderBy("ts", "file", "line_no").select(
        F.concat_ws(" | ", parse.wall_clock("ts"), "origin", "text").alias("value"), "ts", "file", "line_no"
    )


def export_marks(marks: DataFrame, lines: DataFrame) -> DataFrame:
    return marks.join(lines.select("file", "line_no", "text"), ["file", "line_no"], "left")


def save_baseline(fingerprint: DataFrame, path: str, name: str, when: str) -> None:
    """Append a fingerprint under a name; the latest of a name counts."""
    fingerprint.withColumns({"name": F.lit(name), "updated_at": F.lit(when).cast("timestamp_ntz"), "deleted": F.lit(False)}).write.mode("append").parquet(path)


def list_baselines(stored: DataFrame) -> DataFrame:
    """The latest row of each name that is not deleted.  Of rows of one time a deletion counts, then
    the row of the greatest hash."""
    row = F.xxhash64(F.to_json(F.struct(*stored.columns)))
    newest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("updated_at"), F.desc("deleted"), F.desc(row)))
    return stored.withColumn("_r", newest).where("_r = 1 and not deleted").drop("_r")


def delete_baseline(spark, path: str, name: str, when: str) -> None:
    """Mark a name as deleted from ``when`` on."""
    kept = list_baselines(spark.read.parquet(path)).where(F.col("name") == name)
    kept.withColumns({"updated_at": F.lit(when).cast("timestamp_ntz"), "deleted": F.lit(True)}).write.mode("append").parquet(path)
