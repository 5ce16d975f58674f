"""Search, filters, scopes and mutes: predicates, semi joins and one-scan batches."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import facts, parse
from .ordered import Scan

KEY = ["file", "line_no"]


def pattern_error(pattern: str) -> str | None:
    """What Java, which runs the patterns, finds wrong with one; None for a valid one."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    try:
        spark._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException) as e:
        return str(e).splitlines()[0]
    return None


def compile_pattern(pattern: str, regex: bool = False, wildcard: bool = False, case: bool = True, word: bool = False) -> str | None:
    """A Java pattern for a search; None if it is no valid one."""
    if wildcard and not regex:
        body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    else:
        body = pattern if regex else re.escape(pattern)
    out = ("" if case else "(?i)") + (rf"\b(?:{body})\b" if word else body)
    return out if not regex or pattern_error(out) is None else None


def search(lines: DataFrame, pattern: str, **how) -> DataFrame:
    """One row for each matching line: the first hit's 0-based column and length."""
    p = compile_pattern(pattern, **how)
    hits = lines.where(F.col("text").rlike(p)) if p is not None else lines.where(F.lit(False))
    p = p if p is not None else "x"
    return hits.select(*KEY, (F.regexp_instr("text", F.lit(p)) - 1).alias("column"), F.length(F.regexp_substr("text", F.lit(p))).alias("length"), "text")


#: Marks around hits while their places are counted; of the private use area.
BEGIN, END = "\uf8f0", "\uf8f1"


def search_all(lines: DataFrame, pattern: str, **how) -> DataFrame:
    """Every hit that is not empty: 0-based column and length, in characters.

    Hits are put between marks; the pieces of the marked text then give all places.  The marks
    themselves, U+F8F0 and U+F8F1, count as spaces where a text holds them.
    """
    p = compile_pattern(pattern, **how)
    if p is None:
        return lines.where(F.lit(False)).select(*KEY, F.lit(0).alias("column"), F.lit(0).alias("length"))
    text = F.translate("text", BEGIN + END, "  ")
    pieces = F.split(F.regexp_replace(text, F.lit(p), F.lit(f"{BEGIN}$0{END}")), BEGIN)
    start = F.struct(F.length(F.get("_p", F.lit(0))).alias("at"), F.array().cast("array<struct<column:int,length:int>>").alias("hits"))

    def step(acc: Column, piece: Column) -> Column:
        hit = F.instr(piece, END) - 1
        found = F.struct(acc["at"].alias("column"), hit.alias("length"))
        return F.struct((acc["at"] + F.length(piece) - 1).alias("at"), F.concat(acc["hits"], F.array(found)).alias("hits"))

    rows = lines.where(F.col("text").rlike(p)).select(*KEY, pieces.alias("_p"))
    hits = F.aggregate(F.slice("_p", F.lit(2), F.size("_p")), start, step)["hits"]
    out = rows.select(*KEY, F.explode(hits).alias("h")).select(*KEY, "h.column", "h.length")
    return out.where("length > 0")


def search_columns(lines: DataFrame, pattern: str, delimiter: str, visible: list[bool], **how) -> DataFrame:
    """Search only what visible columns show."""
    return search(facts.forget(lines).withColumn("text", parse.project_columns("text", delimiter, visible)), pattern, **how)


def hidden_column_matches(lines: DataFrame, pattern: str, delimiter: str, visible: list[bool], **how) -> DataFrame:
    """Lines that match only in hidden columns."""
    return search(lines, pattern, **how).join(search_columns(lines, pattern, delimiter, visible, **how), KEY, "left_anti")


def search_in_filter(hits: DataFrame, shown: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Hits with the rank of their line in a filtered view; null where the view hides it."""
    ranks = Scan(shown.select(*KEY).distinct(), chunk=chunk).number("display_index")
    return hits.join(ranks, KEY, "left").withColumn("visible", F.col("display_index").isNotNull())


def _hits(patterns: dict[str, str | dict], case: bool) -> dict[str, Column]:
    """A predicate for each pattern: a regex, or a dict of ``pattern`` and options of
    :func:`compile_pattern` (plain text unless ``regex`` is set) and ``invert``.  What is no
    valid pattern matches nothing, inverted or not."""
    out = {}
    for name, given in patterns.items():
        options = {"pattern": given, "regex": True} if isinstance(given, str) else dict(given)
        invert = options.pop("invert", False)
        p = compile_pattern(**{"case": case} | options) if options.get("pattern") else None
        hit = F.col("text").rlike(p) if p is not None else F.lit(False)
        out[name] = ~hit if invert and p is not None else hit
    return out


def search_batch(lines: DataFrame, patterns: dict[str, str | dict], case: bool = True) -> DataFrame:
    """A row for each line and pattern that matches it, from one scan with all patterns."""
    ids = F.array(*[F.when(hit, name) for name, hit in _hits(patterns, case).items()])
    return lines.select(*KEY, "text", F.explode(F.filter(ids, lambda x: x.isNotNull())).alias("pattern_id"))


def batch_counts(lines: DataFrame, patterns: dict[str, str | dict], case: bool = True) -> DataFrame:
    return search_batch(lines, patterns, case).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("matches"), F.min("line_no").alias("first_line"))


def grouped_batch(lines: DataFrame, patterns: dict[str, str | dict], case: bool = True) -> DataFrame:
    """One row for each line with the sorted names of what matches it."""
    ids = F.filter(F.array(*[F.when(hit, name) for name, hit in sorted(_hits(patterns, case).items())]), lambda x: x.isNotNull())
    return lines.select(*KEY, ids.alias("ids")).where(F.size("ids") > 0).select(*KEY, F.array_join("ids", ",").alias("patterns"))


def search_folder(lines: DataFrame, pattern: str, per_file: int | None = None, total: int | None = None, cut: int | None = None, **how) -> DataFrame:
    """All hits with their whole text; the first ``per_file`` of each file, the first ``total`` in
    order of file and line, and ``cut`` characters of the text where these are given."""
    hits = search(lines, pattern, **how)
    if per_file is not None:
        first = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
        hits = hits.withColumn("_r", first).where(F.col("_r") <= per_file)
    if total is not None:
        hits = hits.orderBy(*KEY).limit(total)
    return hits.select(*KEY, "column", "text" if cut is None else F.substring("text", 1, cut).alias("text"))


def with_context(hits: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """Lines up to n before or behind a hit, each once."""
    near = hits.select("file", F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") + n)).alias("line_no")).distinct()
    return lines.join(near, KEY, "left_semi")


def _rule(pattern: str, case: bool) -> Column:
    p = compile_pattern(pattern, regex=True, case=case) or compile_pattern(pattern, case=case)
    return F.col("text").rlike(p)


def filter_basic(lines: DataFrame, levels: list[str] | None = None, include: list[str] = (), exclude: list[str] = (), case: bool = False, context: int = 0) -> DataFrame:
    """Lines of given levels that match any include, with context around them; excluded lines
    are dropped last, context or not.  Invalid patterns count as plain text."""
    keep = F.lit(True)
    if levels:
        keep &= F.coalesce(facts.level(lines), F.lit("other")).isin(levels)
    if include:
        keep &= F.array_contains(F.array(*[_rule(p, case) for p in include]), True)
    out = lines.where(keep)
    if context:
        out = with_context(out, lines, context)
    for p in exclude:
        out = out.where(~_rule(p, case))
    return out


def filter_advanced(lines: DataFrame, groups: list[dict]) -> DataFrame:
    """Groups of rules: ``{"operator": "AND" | "OR", "rules": [(type, value, case)]}``, all groups
    ANDed.  One predicate that Catalyst can push and fold."""

    def rule(kind: str, value: str, case: bool = False) -> Column:
        negated, base = kind.startswith("not_"), kind.removeprefix("not_")
        if base == "level":
            hit = F.coalesce(facts.level(lines), F.lit("other")) == value
        elif base == "contains":
            hit = F.contains("text", F.lit(value)) if case else F.contains(F.lower("text"), F.lit(value.lower()))
        else:
            p = compile_pattern(value, regex=True, case=case)
            hit = F.col("text").rlike(p) if p is not None else F.lit(False)
        return ~hit if negated else hit

    keep = F.lit(True)
    for group in groups:
        rules = [rule(*r) for r in group["rules"]]
        if rules:
            both = rules[0]
            for r in rules[1:]:
                both = both | r if group["operator"] == "OR" else both & r
            keep &= both
    return lines.where(keep)


def filter_column(lines: DataFrame, index: int, value: str, how: str = "equals", delimiter: str = " ") -> DataFrame:
    """Lines by one column's cell: ``equals``, ``contains`` or ``regex``; an invalid pattern matches nothing."""
    cell = F.coalesce(F.get(parse.split_columns("text", delimiter), F.lit(index)), F.lit(""))
    if how == "regex":
        p = compile_pattern(value, regex=True)
        return lines.where(cell.rlike(p) if p is not None else F.lit(False))
    return lines.where({"equals": cell == value, "contains": F.contains(cell, F.lit(value))}[how])


def scope_range(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Lines of a range; reversed bounds are swapped."""
    return lines.where(F.col("line_no").between(max(0, min(start, end)), max(start, end)))


def scope_of(lines: DataFrame, other: DataFrame) -> DataFrame:
    """Lines that another result holds."""
    return lines.join(other.select(*KEY).distinct(), KEY, "left_semi")


def out_of_scope(lines: DataFrame, other: DataFrame) -> DataFrame:
    return lines.join(other.select(*KEY).distinct(), KEY, "left_anti")


def scope_component(lines: DataFrame, name: str) -> DataFrame:
    return lines.where(facts.component(lines) == name)


def scope_time(lines: DataFrame, start: str, end: str) -> DataFrame:
    """Lines whose own time lies in the span."""
    span = F.col("_own").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    return lines.withColumn("_own", facts.ts(lines)).where(span).drop("_own")


def time_window(lines: DataFrame, start: str, end: str) -> DataFrame:
    """All lines, timed or not, from the first at or after start to the last at or before end."""
    ts = facts.ts(lines)
    first = F.min(F.when(ts >= F.lit(start).cast("timestamp_ntz"), F.col("line_no")))
    last = F.max(F.when(ts <= F.lit(end).cast("timestamp_ntz"), F.col("line_no")))
    bounds = lines.groupBy("file").agg(first.alias("_a"), last.alias("_b"))
    return lines.join(bounds, "file").where(F.col("line_no").between(F.col("_a"), F.col("_b"))).drop("_a", "_b")


def compose_scopes(lines: DataFrame, scopes: list[DataFrame]) -> DataFrame:
    for s in scopes:
        lines = scope_of(lines, s)
    return lines


def next_problem(lines: DataFrame, marks: DataFrame, forward: bool = True, least_rank: int = 1, chunk: int = 100_000) -> DataFrame:
    """For each mark the nearest line, strictly behind (or before) it, of at least a severity."""
    problems = lines.where(facts.severity(lines) >= least_rank).select(*KEY, F.lit(0).alias("_kind"))
    both = problems.unionByName(marks.select(*KEY, F.lit(1).alias("_kind")).distinct())
    # Marks sort so that a problem on the mark's own line lies on the far side.
    both = both.withColumn("_order", F.col("line_no") * 2 + (F.col("_kind") if forward else 1 - F.col("_kind")))
    both = both.withColumn("_problem", F.when(F.col("_kind") == 0, F.col("line_no")))
    scan = Scan(both, order="_order", chunk=chunk)
    found = scan.next_known("_problem", "problem_line") if forward else scan.last_known("_problem", "problem_line")
    return found.where("_kind = 1").select(*KEY, "problem_line")


def mute(lines: DataFrame, patterns: list[str]) -> DataFrame:
    return lines.where(~parse.muted("text", patterns))


def pattern_match_rate(lines: DataFrame, pattern: str, head: int | None = None) -> DataFrame:
    """How many of the non-blank lines, or of those among the first ``head``, a pattern matches; an invalid
    pattern matches none."""
    some = lines.where(F.trim("text") != "")
    if head is not None:
        some = some.where(F.col("line_no") < head)
    p = compile_pattern(pattern, regex=True)
    hit = (F.col("text").rlike(p) if p is not None else F.lit(False)).cast("long")
    return some.groupBy("file").agg(F.sum(hit).alias("matched"), F.count(F.lit(1)).alias("scanned"), F.round(F.avg(hit), 6).alias("rate"))


def pattern_audit(lines: DataFrame, patterns: dict[str, str | dict], case: bool = True) -> DataFrame:
    """For each saved pattern (see :func:`search_batch`): whether it is valid, matched lines, share,
    first and last line, lines that match more than once; and what is doubtful about it."""
    known = []
    for name, given in patterns.items():
        options = {"pattern": given, "regex": True} if isinstance(given, str) else dict(given)
        options.pop("invert", None)
        source = options.get("pattern") or ""
        p = compile_pattern(**{"case": case} | options) if source else None
        doubt = [
            *(["empty"] if not source else ["invalid"] if p is None else []), *(["long"] if len(p or source) > 1000 else []),
            *(["nested quantifier"] if re.search(r"\([^)]*[+*][^)]*\)[+*]", p or source) else []), *(["leading .*"] if re.match(r"(\(\?i\))?\^?\.[*+]", p or source) else []),
        ]
        known.append((name, p is not None, ", ".join(doubt), p or "(?!)", bool(given.get("invert")) if isinstance(given, dict) else False))
    table = lines.sparkSession.createDataFrame(known, "pattern_id string, valid boolean, warning string, _p string, _inv boolean")
    hits = search_batch(lines, patterns, case)
    twice = F.coalesce(*[F.when(F.col("pattern_id") == k[0], F.lit(0) if k[4] else F.regexp_count("text", F.lit(k[3]))) for k in known])
    total = lines.agg(F.count(F.lit(1)).alias("scanned"))
    seen = hits.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("matched"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum((twice > 1).cast("long")).alias("multi")
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return F.broadcast(table).join(seen, "pattern_id", "left").join(F.broadcast(total)).select(
        "pattern_id", "valid", zero("matched"), "scanned", F.round(F.coalesce("matched", F.lit(0)) / F.col("scanned"), 6).alias("share"), "first_line", "last_line", zero("multi"), "warning"
    )
