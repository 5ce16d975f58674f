"""Exact medians of groups of any size, by histograms that are refined around the middle.

A built-in median gathers a group's distinct values in one task.  Here each round counts a
group's values in BINS bins between two bounds, which are partial sums of a bounded number of
rows, and takes the bin that holds the wanted rank as the next bounds, until it is one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import store

#: Bins of a round: whole numbers up to 2^40 apart take five rounds.
BINS = 1 << 10


def middles(rows: DataFrame, by: list[str], value: Column | str, bins: int = BINS) -> DataFrame:
    """``(*by, n, low, high)`` for each group: how many whole numbers it has, and the middle one; of an even
    number the two in the middle.  Nulls do not count; a group of nulls only has no row."""
    number = F.col(value) if isinstance(value, str) else value
    values = store(rows.select(*by, number.cast("long").alias("_v")).where("_v is not null"), "values")
    spans = values.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.array(F.floor((F.col("n") - 1) / 2).cast("long"), F.floor(F.col("n") / 2).cast("long"))
    now = store(spans.select(*by, "n", "_lo", "_hi", F.posexplode(ranks).alias("_side", "_rank")), "middles")
    key = [*by, "_side"]
    while now.where("_lo < _hi").head(1):
        width = F.floor((F.col("_hi") - F.col("_lo")) / bins).cast("long") + 1
        wide = now.where("_lo < _hi").withColumn("_width", width)
        bin_ = F.expr("(_v - _lo) div _width")
        held = _join(values, wide, by).where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counts = held.groupBy(*key, "n", "_lo", "_hi", "_rank", "_width", bin_.alias("_bin")).agg(F.count(F.lit(1)).alias("_c"))
        upto = F.sum("_c").over(Window.partitionBy(*key).orderBy("_bin"))  # at most ``bins`` rows
        here = counts.withColumn("_upto", upto).where((F.col("_upto") > F.col("_rank")) & (F.col("_upto") - F.col("_c") <= F.col("_rank")))
        low = F.col("_lo") + F.col("_bin") * F.col("_width")
        finer = here.select(*by, "n", low.alias("_lo"), F.least("_hi", low + F.col("_width") - 1).alias("_hi"), "_side", (F.col("_rank") - F.col("_upto") + F.col("_c")).alias("_rank"))
        now = store(finer.unionByName(now.where("_lo >= _hi")), "middles")
    return now.groupBy(*by, "n").agg(F.min("_lo").alias("low"), F.max("_lo").alias("high"))


def _join(values: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Values with their group's bounds; without ``by`` there are two rows of those."""
    return values.join(groups, by) if by else values.join(F.broadcast(groups))
