"""Ordered scans that do not gather a log in one task.

A plain window over a file's lines would sort the whole file in one task.  Here lines are
dealt into chunks of consecutive order values; windows run inside chunks, and what crosses
a chunk's edge comes from one summary row for each chunk, scanned per file and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = 100_000


class Scan:
    """Rows with an order inside groups.  ``by`` are the groups' columns (such as file),
    ``order`` a whole number that orders rows inside a group; where it repeats, the columns of
    ``tie`` order the rows."""

    def __init__(self, rows: DataFrame, order: str = "line_no", by: tuple[str, ...] = ("file",), chunk: int = CHUNK, tie: tuple[str, ...] = ()):
        self.rows, self.order, self.by = rows, order, list(by)
        self.place = F.struct(order, *tie) if tie else F.col(order)
        self.chunked = rows.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long"))
        self.keys = [*self.by, "_chunk"]
        self.inside = Window.partitionBy(*self.keys).orderBy(order, *tie)
        self.chunks = Window.partitionBy(*self.by).orderBy("_chunk")

    def _carry(self, value: Column, over: Column, name: str) -> DataFrame:
        """Chunked rows with ``_in``: what the chunks before (or behind) hand over."""
        summary = self.chunked.groupBy(*self.keys).agg(value.alias("_v")).withColumn(name, over)
        return self.chunked.join(summary.drop("_v"), self.keys)

    def _done(self, df: DataFrame) -> DataFrame:
        return df.drop("_chunk", "_in", "_rn")

    def lag(self, column: str, out: str) -> DataFrame:
        """The value of the row before."""
        last = F.max_by(F.struct(F.col(column).alias("v")), self.place)
        df = self._carry(last, F.lag("_v").over(self.chunks), "_in").withColumn("_rn", F.row_number().over(self.inside))
        value = F.when(F.col("_rn") == 1, F.col("_in.v")).otherwise(F.lag(column).over(self.inside))
        return self._done(df.withColumn(out, value))

    def last_known(self, column: str, out: str) -> DataFrame:
        """The last value that is not null, up to and with the row."""
        known = F.max_by(column, F.when(F.col(column).isNotNull(), self.place))
        before = self.chunks.rowsBetween(Window.unboundedPreceding, -1)
        df = self._carry(known, F.last("_v", True).over(before), "_in")
        up_to = self.inside.rowsBetween(Window.unboundedPreceding, 0)
        return self._done(df.withColumn(out, F.coalesce(F.last(column, True).over(up_to), F.col("_in"))))

    def next_known(self, column: str, out: str) -> DataFrame:
        """The first value that is not null, from the row on."""
        known = F.min_by(column, F.when(F.col(column).isNotNull(), self.place))
        behind = self.chunks.rowsBetween(1, Window.unboundedFollowing)
        df = self._carry(known, F.first("_v", True).over(behind), "_in")
        on = self.inside.rowsBetween(0, Window.unboundedFollowing)
        return self._done(df.withColumn(out, F.coalesce(F.first(column, True).over(on), F.col("_in"))))

    def both_known(self, column: str, before: str, behind: str) -> DataFrame:
        """The last value that is not null up to the row, and the first from it on, in one pass."""
        when = F.when(F.col(column).isNotNull(), self.place)
        ends = self.chunked.groupBy(*self.keys).agg(F.max_by(column, when).alias("_l"), F.min_by(column, when).alias("_f"))
        ends = ends.select(
            *self.keys, F.last("_l", True).over(self.chunks.rowsBetween(Window.unboundedPreceding, -1)).alias("_in"),
            F.first("_f", True).over(self.chunks.rowsBetween(1, Window.unboundedFollowing)).alias("_out"),
        )
        last = F.last(column, True).over(self.inside.rowsBetween(Window.unboundedPreceding, 0))
        first = F.first(column, True).over(self.inside.rowsBetween(0, Window.unboundedFollowing))
        df = self.chunked.join(ends, self.keys).withColumns({before: F.coalesce(last, F.col("_in")), behind: F.coalesce(first, F.col("_out"))})
        return self._done(df.drop("_out"))

    def number(self, out: str) -> DataFrame:
        """0-based number of the row in its group."""
        before = self.chunks.rowsBetween(Window.unboundedPreceding, -1)
        df = self._carry(F.count(F.lit(1)), F.coalesce(F.sum("_v").over(before), F.lit(0)), "_in")
        return self._done(df.withColumn(out, F.row_number().over(self.inside) - 1 + F.col("_in")))

    def running_max(self, column: str, out: str) -> DataFrame:
        before = self.chunks.rowsBetween(Window.unboundedPreceding, -1)
        df = self._carry(F.max(column), F.max("_v").over(before), "_in")
        up_to = self.inside.rowsBetween(Window.unboundedPreceding, 0)
        return self._done(df.withColumn(out, F.greatest(F.max(column).over(up_to), F.col("_in"))))

    def running_sum(self, column: str, out: str) -> DataFrame:
        before = self.chunks.rowsBetween(Window.unboundedPreceding, -1)
        df = self._carry(F.sum(column), F.coalesce(F.sum("_v").over(before), F.lit(0)), "_in")
        up_to = self.inside.rowsBetween(Window.unboundedPreceding, 0)
        return self._done(df.withColumn(out, F.sum(column).over(up_to) + F.col("_in")))
