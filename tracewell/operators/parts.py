"""Profiles as parts that add up: the profile of a union is the merge of its parts.

A part is a small table of sums by file, kind and key: lines by level, component and crash word,
by minute, and by field with a sketch of its distinct values.  Parts are kept beside the lines they
are of, so a new file, or new lines of one, cost what they hold and no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import facts, parse
from . import trend
from .profile import component_errors, tallies

COLUMNS = ("file", "kind", "key", "n", "bad", "warned", "first_line", "sketch")
#: Registers of a sketch, as a power of two: a standard error of 1.6 %.
REGISTERS = 12


def profile_parts(lines: DataFrame) -> DataFrame:
    """``COLUMNS`` for lines: kinds ``lines``, ``level``, ``crash``, ``component`` (``bad`` and ``warned`` lines), ``minute``
    (since 1970) and ``field`` (``sketch`` of its values).  ``first_line`` is the first line (for a component the first error)."""
    seen = tallies(lines)
    zero, none = F.lit(0).cast("long"), F.max(F.lit(None).cast("binary")).alias("sketch")

    def part(rows: DataFrame, kind: str, key: Column, n: Column, first: Column, bad: Column = zero, warned: Column = zero, sketch: Column = none) -> DataFrame:
        grouped = rows.groupBy("file", F.lit(kind).alias("kind"), key.cast("string").alias("key"))
        return grouped.agg(n.alias("n"), F.sum(bad).alias("bad"), F.sum(warned).alias("warned"), first.cast("long").alias("first_line"), sketch).select(*COLUMNS)

    n, first = F.sum("n"), F.min("first_line")
    errors = component_errors(lines).withColumnRenamed("lines", "n")
    out = part(seen, "lines", F.lit(""), n, first)
    for kind, column in (("level", "level"), ("crash", "crash")):
        out = out.unionByName(part(seen.where(F.col(column).isNotNull()), kind, F.col(column), n, first))
    out = out.unionByName(part(errors, "component", F.col("component"), n, F.min("first_error"), F.col("errors"), F.col("warnings")))
    timed = lines.select("file", "line_no", F.floor(parse.epoch_ms(facts.ts(lines)) / 60_000).alias("minute")).where("minute is not null")
    out = out.unionByName(part(timed, "minute", F.col("minute"), F.count(F.lit(1)), F.min("line_no")))
    fields = trend.field_rows(lines)
    return out.unionByName(part(fields, "field", F.col("name"), F.count(F.lit(1)), F.min("line_no"), sketch=F.hll_sketch_agg("raw", REGISTERS).alias("sketch")))


def merge_parts(parts: DataFrame) -> DataFrame:
    """Parts of several runs, or of several stretches of a file, as one."""
    return parts.groupBy("file", "kind", "key").agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("warned").alias("warned"), F.min("first_line").alias("first_line"), F.hll_union_agg("sketch", F.lit(False)).alias("sketch")
    ).select(*COLUMNS)


def levels_of(parts: DataFrame) -> DataFrame:
    """Lines by file and level."""
    return merge_parts(parts).where("kind = 'level'").select("file", F.col("key").alias("level"), F.col("n").alias("lines"))


def worst_components(parts: DataFrame, k: int = 5) -> DataFrame:
    """:func:`profile.merge_analysis` from parts: components over all files, and their first error's file and line."""
    of = merge_parts(parts).where("kind = 'component'")
    first = F.min(F.when(F.col("first_line").isNotNull(), F.struct("file", "first_line"))).alias("_f")
    whole = of.groupBy("key").agg(F.sum("bad").alias("errors"), F.sum("warned").alias("warnings"), first).where("errors > 0")
    return whole.orderBy(F.desc("errors"), "key").limit(k).select(F.col("key").alias("component"), "errors", "warnings", F.col("_f.file").alias("file"), F.col("_f.first_line").alias("first_error"))


def fields_of(parts: DataFrame) -> DataFrame:
    """Fields over all files: occurrences and about how many distinct values."""
    of = parts.where("kind = 'field'").groupBy("key").agg(F.sum("n").alias("occurrences"), F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(False))).alias("distinct"))
    return of.withColumnRenamed("key", "name")
