"""Running streams over tables to their end, into tables that batch verbs read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import file_system, is_folder, scratch, store


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table's Parquet file or folder as a stream."""
    path = f"{sf_dir}/{table}.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema)
    # a stream's plain path must be a folder; a pattern may also match a single file
    return stream.parquet(path if is_folder(spark, path) else path.removesuffix("t") + "[t]")


def finish(stream: DataFrame, name: str) -> DataFrame:
    """Run an append stream over what there is now; what it wrote."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)
    q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, name + "-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def finish_complete(stream: DataFrame, name: str) -> DataFrame:
    """Run an aggregating stream over what there is now; its last complete result."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)
    write = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    q = stream.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", scratch(spark, name + "-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: A detector: from a micro-batch and what the ones before handed over (None at first) to what
#: it found and what it hands on.  It may have ``facts``: what it reads of a micro-batch, worked out
#: once and kept while the micro-batch is looked at.
Detector = Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]


def start_detector(stream: DataFrame, detector: Detector, out: str, kept: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a detector on a stream: what it finds goes to Parquet below ``out``, what it hands on
    below ``kept``; all three paths are the same again after a restart.

    Each micro-batch is a batch query, so its rows are spread over tasks as any table's are.
    Results are written below the number of the micro-batch, and what is handed on is read from
    the last one's, so a micro-batch that is run again after a failure writes the same once more.
    """

    def step(rows: DataFrame, number: int) -> None:
        spark, before = rows.sparkSession, None
        if number:
            where, files = file_system(spark, f"{kept}/{number - 1}")
            if not files.exists(where):
                raise FileNotFoundError(f"micro-batch {number} finds nothing that the one before handed on below {kept}")
            before = spark.read.parquet(f"{kept}/{number - 1}")
        rows = getattr(detector, "facts", lambda r: r)(rows)
        rows = rows.persist(StorageLevel.DISK_ONLY)  # read several times; lost blocks are read from the source again
        found, carry = detector(rows, before)
        carry.write.mode("overwrite").parquet(f"{kept}/{number}")
        found.write.mode("overwrite").parquet(f"{out}/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def detect(stream: DataFrame, detector: Detector, name: str) -> DataFrame:
    """Run a detector over what a stream has now; all that it found."""
    spark, out = stream.sparkSession, scratch(stream.sparkSession, name)
    start_detector(stream, detector, out, scratch(spark, name + "-carry"), scratch(spark, name + "-state"), availableNow=True).awaitTermination()
    none, _ = detector(spark.createDataFrame([], stream.schema), None)
    where, files = file_system(spark, out)
    if not files.exists(where):  # a stream without any rows
        return none
    return spark.read.schema(none.schema).parquet(f"{out}/batch=*")


#: Rows of an arrival that one file holds, about: what one task writes.  Changes no result.
ROWS_A_FILE = 100_000


def arrive(rows: DataFrame, order: str, times: int, name: str) -> DataFrame:
    """Rows as a stream of so many arrivals, in the order of a column: ranges of it are written
    one after the other, each as equally many files, and each is a micro-batch.  It stages the queries of live verbs.

    The rows are worked out once, by all tasks, and so is each arrival.  Where rows did not come to each of an
    arrival's files, files without rows take their place, so that no micro-batch reads into the next arrival.
    """
    spark, path = rows.sparkSession, scratch(rows.sparkSession, name)
    rows = store(rows, name + "-rows")
    shares = [k / times for k in range(1, times)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(order, shares or [0.5]).alias("bounds")).first()
    limits = [None, *sorted(set(seen["bounds"] or []) if shares else []), None]
    each = max(1, -(-seen["n"] // (times * ROWS_A_FILE)))
    where, files = file_system(spark, path)
    for k, (low, high) in enumerate(zip(limits, limits[1:], strict=False)):
        some = rows
        if low is not None:
            some = some.where(rows[order] >= low)
        if high is not None:
            some = some.where(rows[order] < high)
        some.repartition(each).write.mode("append").parquet(path)
        written = sum(f.getPath().getName().startswith("part-") for f in files.listStatus(where))
        for _ in range(each * (k + 1) - written):
            rows.where(F.lit(False)).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", each).parquet(path)
