"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of text in one Arrow batch.  Texts can be long, so a batch holds few.
TEXT_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    It is ``spark.checkpoint.dir``.  Only where that is unset (local tests) a
    local folder is chosen and remembered in the session.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = spark.conf.get("tracewell.checkpoint.dir", None)
    if not where:
        local = os.path.join(tempfile.gettempdir(), "checkpoints")
        os.makedirs(local, exist_ok=True)
        where = "file://" + tempfile.mkdtemp(prefix="tracewell-", dir=local)
        spark.conf.set("tracewell.checkpoint.dir", where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and
    survives lost executors, because the files belong to no executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tracewell_path = path
    for made in _made:
        made.append(out)
    return out


#: What is being written inside :func:`temporary_tables`.
_made: list[list[DataFrame]] = []


@contextmanager
def temporary_tables() -> Iterator[None]:
    """Delete, at the end, the tables that :func:`materialize` wrote meanwhile.  For whoever
    has a result written in between; what a lazy result still reads must not be deleted."""
    made: list[DataFrame] = []
    _made.append(made)
    try:
        yield
    finally:
        _made.remove(made)
        for table in made:
            discard(table)


def keep_table(df: DataFrame) -> DataFrame:
    """Take a table out of the ones that :func:`temporary_tables` deletes."""
    for made in _made:
        made[:] = [t for t in made if t is not df]
    return df


def discard(df: DataFrame) -> None:
    """Delete the files of a table that :func:`materialize` wrote and nothing reads any more."""
    path = getattr(df, "_tracewell_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Let Arrow batches hold at most so many rows, as one row can hold a very long text.

    The setting is the session's.  It is only ever lowered, so that queries that run later
    than they were made, or beside each other, all find a bound that suits them.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def carried(also: tuple[str, ...], added: tuple[str, ...]) -> tuple[str, ...]:
    """Columns to carry along: those that an operator adds itself replace ones of their names."""
    return tuple(c for c in also if c not in added)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def key_mod(column: str, divisor: int) -> F.Column:
    """crc32 of a key as text, modulo ``divisor``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def raw_texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def whole_runs(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int = 1 << 16) -> Iterator[pa.Table]:
    """Regroup batches sorted by ``keys`` into tables that never cut a run of equal keys.

    A table has at least ``rows`` rows (but the last), or as many as one run has.
    """
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = run_starts(table, keys)
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches()
            count = table.num_rows - cut
        else:  # one run so far: wait for its end before looking again
            held = table.to_batches()
            rows = max(rows, 2 * count)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a run of equal ``keys`` (non-null integers) begins."""
    new = np.zeros(table.num_rows, bool)
    if table.num_rows:
        new[0] = True
    for key in keys:
        v = table[key].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def split_hot_keys(df: DataFrame, keys: list[str], identity: str, cap: int) -> DataFrame:
    """Deal the rows of keys with more than ``cap`` rows into blocks, and send each block
    to every pair of blocks, so that any two rows of a key still meet in one place.

    Adds ``blk_lo``, ``blk_hi`` (the pair of blocks) and ``blk`` (the row's own).  A key
    of at most ``cap`` rows stays whole as (0, 0).  In a pair with ``blk_lo < blk_hi`` only
    rows of different blocks need comparing.  No row or pair is dropped.

    The hot keys are a table of their own, so Spark knows its size when it joins: a small
    one is broadcast, and a large one leaves a join that adaptive execution can split.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > cap)
    hot = materialize(counts.select(*keys, F.ceil(F.col("_n") / cap).cast("int").alias("_blocks")), "hot-keys")
    out = df.join(hot, keys, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    out = out.withColumn("blk", F.pmod(F.xxhash64(F.lit("block"), identity), F.col("_blocks")).cast("int"))
    pairs = F.expr(
        "transform(sequence(0, _blocks - 1), j -> struct(least(blk, j) as blk_lo, greatest(blk, j) as blk_hi))"
    )
    return out.withColumn("_pair", F.explode(pairs)).select(
        *df.columns, "blk", F.col("_pair.blk_lo").alias("blk_lo"), F.col("_pair.blk_hi").alias("blk_hi")
    )


def bounded_cache(size: int, make: Callable[[str], object]) -> Callable[[str], object]:
    """A memo for repeated words that forgets everything once it holds ``size`` words."""
    memo: dict[str, object] = {}

    def get(word: str) -> object:
        found = memo.get(word)
        if found is None:
            if len(memo) >= size:
                memo.clear()
            found = memo[word] = make(word)
        return found

    return get
