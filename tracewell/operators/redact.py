"""Redaction with numbered placeholders, and with rules of the user's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, parse
from .ordered import CHUNK, Scan

KEY = ["file", "line_no"]


def found_secrets(lines: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """A row for each secret of each line: prefix, value and where it stands first in the line."""
    hits = F.flatten(
        F.array(*[
            F.expr(f"transform(array_distinct(regexp_extract_all(text, {_sql(p)}, 0)), v -> named_struct('prefix', {_sql(prefix)}, 'value', v))")
            for p, prefix in rules
        ])
    )
    rows = lines.select(*KEY, "text", F.explode(hits).alias("h")).select(*KEY, "text", "h.prefix", "h.value")
    return rows.withColumn("pos", F.instr("text", F.col("value"))).drop("text")


def _sql(text: str) -> str:
    return "r'" + text.replace("'", "\\x27") + "'"


def numbered(lines: DataFrame, rules: list[tuple[str, str]] = parse.REDACTIONS, chunk: int = CHUNK) -> DataFrame:
    """Secrets as ``[PREFIX-n]``, numbered by prefix in the order in which values first occur.

    The dictionary is a table: a row for each distinct value, numbered by an ordered scan, and
    joined back to the lines that hold it.
    """
    secrets = found_secrets(lines, rules)
    first = secrets.groupBy("prefix", "value").agg(F.min(F.struct("file", "line_no", "pos")).alias("at"))
    first = first.select("prefix", "value", "at.file", "at.line_no", "at.pos")
    files = first.groupBy("prefix", "file").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy("prefix").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_base", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    ranked = Scan(first, by=("prefix", "file"), chunk=chunk, tie=("pos", "value")).number("_n").join(files, ["prefix", "file"])
    names = ranked.select("prefix", "value", F.concat(F.lit("["), "prefix", F.lit("-"), (F.col("_base") + F.col("_n") + 1).cast("string"), F.lit("]")).alias("name"))
    used = secrets.join(names, ["prefix", "value"]).groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct((-F.length("value")).alias("n"), "value", "name"))).alias("_s"))
    joined = facts.forget(lines).join(used, KEY, "left")
    text = F.aggregate("_s", F.col("text"), lambda acc, s: F.replace(acc, s["value"], s["name"]))
    return joined.withColumn("text", F.coalesce(text, F.col("text"))).drop("_s")


def custom(lines: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """The built-in redaction, then the user's (pattern, replacement) rules in order."""
    text = parse.redact_hashed("text")
    for pattern, by in rules:
        text = F.regexp_replace(text, pattern, by)
    return facts.forget(lines).withColumn("text", text)
