"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Where views of tables are stored, by session, folder and the table's files.
_stored: dict[tuple, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local one only where that is unset, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        local = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(local, exist_ok=True)
        where = "file://" + local
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """Hadoop's view of a path and of the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def is_folder(spark: SparkSession, path: str) -> bool:
    where, files = file_system(spark, path)
    return files.getFileStatus(where).isDirectory()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it from there."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _spread(df: DataFrame) -> DataFrame:
    """A view of a scan (without a shuffle of its own) that has fewer splits than there are cores:
    its rows are dealt by file and line, so that what reads the table can use them all."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    keys = [c for c in ("file", "line_no") if c in df.columns]
    if not keys or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartitionByRange(cores, *keys).sortWithinPartitions(*keys)


def store_once(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` stored once for a session, as long as the files at ``source`` stay the same."""
    where, files = file_system(spark, source)
    status = files.listStatus(where)
    marks = tuple((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in status)
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), source, name, marks)
    path = _stored.get(key)
    if path is not None:
        where, files = file_system(spark, path)
        if files.exists(where):
            return spark.read.parquet(path)
    df = make()
    path = scratch(spark, name)
    _spread(df).write.parquet(path)
    _stored[key] = path
    return spark.read.schema(df.schema).parquet(path)
