"""A log that is taken in as it grows: stored lines with their facts, a manifest, and profiles.

Each run looks at the files' lengths and times and takes in what is new: whole new files, and of a
file that has grown the lines behind the ones that are stored.  The last stored line is taken
again, as it may have been cut off when it was read.  A file that is not the same as before, by
its first and last stored line, or that is shorter or was rewritten, is taken anew; its stored
lines no longer count.

A run is a numbered batch: lines and parts of profiles are written first, the manifest last, so a
run that failed leaves nothing that counts, and the next one writes its number again.  Lines
are never rewritten; what counts follows from the manifest, a row for each file and run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import facts
from ..operators import parts
from .readers import read_lines
from .store import file_system, store

MANIFEST = "file string, bytes long, changed timestamp, from_line long, lines long, first_length int, first_mark string, last_length int, last_mark string, batch long"


def _exists(spark: SparkSession, path: str) -> bool:
    where, files = file_system(spark, path)
    return files.exists(where)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """A row for each file and run that took in some of it."""
    if not _exists(spark, f"{root}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/*")


def _latest(known: DataFrame) -> DataFrame:
    return known.groupBy("file").agg(F.max_by(F.struct(*[c for c in known.columns if c != "file"]), "batch").alias("l")).select("file", "l.*")


def _mark(text) -> F.Column:
    return F.md5(text.cast("binary"))


def take_in(spark: SparkSession, path: str, root: str) -> int | None:
    """Take in what is new at ``path``; the run's number, or None if nothing is new."""
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))
    log = manifest(spark, root)
    known = _latest(log)
    same = (F.col("k.bytes") == F.col("t.bytes")) & (F.col("k.changed") == F.col("t.changed"))
    new = there.alias("t").join(known.alias("k"), "file", "left").where(~F.coalesce(same, F.lit(False)))
    new = store(new.select("file", "t.bytes", "t.changed", (F.col("t.bytes") > F.col("k.bytes")).alias("grown"), "lines", "first_length", "first_mark", "last_length", "last_mark"), "changed-files")
    names = [r["file"] for r in new.select("file").collect()]  # names of files, which the reader lists as well
    if not names:
        return None
    number = (log.agg(F.max("batch")).first()[0] or 0) + 1
    lines = store(read_lines(spark, names, skip_split_headers=False), "lines-as-read")
    as_stored = lambda which: _mark(F.substring(F.col("text"), F.lit(1), F.col(f"{which}_length"))) == F.col(f"{which}_mark")
    checked = lines.join(new.where("grown and lines > 0"), "file").where("line_no = 0 or line_no = lines - 1")
    good = F.when(F.col("line_no") == 0, as_stored("first")).otherwise(F.lit(True)) & F.when(F.col("line_no") == F.col("lines") - 1, as_stored("last")).otherwise(F.lit(True))
    goes_on = checked.groupBy("file").agg(F.bool_and(good).alias("ok"), F.max("line_no").alias("_seen"), F.first("lines").alias("_n")).where("ok and _seen = _n - 1")
    starts = new.select("file", "bytes", "changed").join(goes_on.select("file", (F.col("_n") - 1).alias("from_line")), "file", "left").withColumn("from_line", F.coalesce("from_line", F.lit(0).cast("long")))
    starts = store(starts, "starts")
    fresh = facts.with_facts(lines.join(starts.select("file", "from_line"), "file").where("line_no >= from_line").drop("from_line"))
    fresh.write.mode("overwrite").parquet(f"{root}/lines/batch={number}")
    fresh = spark.read.parquet(f"{root}/lines/batch={number}")

    last = lines.groupBy("file").agg((F.max("line_no") + 1).alias("lines"))
    closed = fresh.join(last, "file").where("line_no < lines - 1").drop("lines")  # the last line may change yet
    parts.profile_parts(closed).write.mode("overwrite").parquet(f"{root}/profile/batch={number}")
    ends = lines.join(last, "file").where("line_no = 0 or line_no = lines - 1")
    first, final = F.col("line_no") == 0, F.col("line_no") == F.col("lines") - 1
    marks = ends.groupBy("file").agg(
        F.first("lines").alias("lines"), F.max(F.when(first, F.length("text"))).alias("first_length"), F.max(F.when(first, _mark(F.col("text")))).alias("first_mark"),
        F.max(F.when(final, F.length("text"))).alias("last_length"), F.max(F.when(final, _mark(F.col("text")))).alias("last_mark"),
    )
    rows = starts.join(marks, "file", "left").withColumn("lines", F.coalesce("lines", F.lit(0).cast("long"))).withColumn("batch", F.lit(number).cast("long"))
    rows.select(*spark.createDataFrame([], MANIFEST).columns).write.mode("overwrite").parquet(f"{root}/manifest/{number}")
    return number


def _counting(log: DataFrame) -> DataFrame:
    """``(file, batch, until, whole)``: each run's lines of a file count up to ``until`` (excluded), the start of the next
    run's; its parts count only if no later run took the file anew."""
    later = Window.partitionBy("file").orderBy("batch").rowsBetween(1, Window.unboundedFollowing)  # a row for each run
    return log.select("file", "batch", F.min("from_line").over(later).alias("until"))


def taken_in(spark: SparkSession, root: str) -> DataFrame:
    """The lines that count, ``(file, line_no, text)`` with their facts."""
    ends = _counting(manifest(spark, root))
    lines = spark.read.option("basePath", f"{root}/lines").parquet(f"{root}/lines/batch=*").withColumn("batch", F.col("batch").cast("long"))
    return lines.join(ends, ["file", "batch"]).where("until is null or line_no < until").drop("batch", "until")


def stored_profile(spark: SparkSession, root: str) -> DataFrame:
    """The profile of all lines that count, as one part: stored parts are merged, and only each file's last
    line is looked at anew."""
    log = manifest(spark, root)
    valid = _counting(log).where("until is null or until > 0").select("file", "batch")
    stored = spark.read.option("basePath", f"{root}/profile").parquet(f"{root}/profile/batch=*").withColumn("batch", F.col("batch").cast("long"))
    kept = stored.join(valid, ["file", "batch"]).drop("batch")
    ends = _latest(log).where("lines > 0").select("file", (F.col("lines") - 1).alias("line_no"))
    last = taken_in(spark, root).join(ends, ["file", "line_no"])
    return parts.merge_parts(kept.select(*parts.COLUMNS).unionByName(parts.profile_parts(last)))
