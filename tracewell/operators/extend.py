"""Extension points: analyzers, pattern libraries as tables, verbs in SQL, columns by example."""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import facts, parse
from . import library, profile, sequence, trend
from .search import KEY

ANALYZERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_analyzer(name: str, analyzer: Callable[[DataFrame], DataFrame]) -> None:
    """Add a function from lines to a result that :func:`analyze` runs by name."""
    ANALYZERS[name] = analyzer


def analyze(lines: DataFrame, name: str) -> DataFrame:
    return ANALYZERS[name](lines)


def search_library(lines: DataFrame, patterns: DataFrame, case: bool = True) -> DataFrame:
    """Lines by the patterns of a table ``(pattern_id, pattern)``, of any size; see :mod:`library`."""
    return library.search_library(lines, patterns, case)


def register_views(spark: SparkSession, lines: DataFrame, prefix: str = "log") -> None:
    """Temporary views for SQL: ``<prefix>_lines``, ``_gaps``, ``_crashes``, ``_components``."""
    parsed = lines.select(*KEY, "text", facts.level(lines).alias("level"), facts.ts(lines).alias("ts"), facts.component(lines).alias("component"))
    for name, df in {"lines": parsed, "gaps": sequence.time_gaps(lines), "crashes": profile.crash_sites(lines), "components": profile.component_errors(lines)}.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")


class LogMatches:
    """``log_matches(TABLE(lines), pattern)``: the first hit of a regex in each line that it matches."""

    def __init__(self) -> None:
        self.found = {}

    def eval(self, row, pattern: str):
        if pattern not in self.found:
            try:
                self.found[pattern] = re.compile(pattern)
            except re.error:  # no valid pattern matches nothing
                self.found[pattern] = re.compile("(?!)")
        m = self.found[pattern].search(row["text"] or "")
        if m:
            yield row["file"], row["line_no"], m.start(), m.end() - m.start(), row["text"]


class LogLevel:
    """``log_level(TABLE(lines), level)``: lines whose level word is one of the level's."""

    WORDS = {"fatal": "FATAL|CRITICAL|PANIC", "error": "ERROR|ERR", "warning": "WARN|WARNING", "info": "INFO|NOTICE", "debug": "DEBUG", "trace": "TRACE|VERBOSE"}

    def eval(self, row, level: str):
        words = self.WORDS.get(level)
        m = re.search(rf"\b({'|'.join(self.WORDS.values())})\b", row["text"] or "") if words else None
        if m and re.fullmatch(words, m[1]):
            yield row["file"], row["line_no"], row["text"]


class LogGaps:
    """``log_gaps(TABLE(lines) PARTITION BY (file) ORDER BY (line_no), seconds)``: silences inside each
    partition, which holds one line at a time."""

    def __init__(self) -> None:
        self.before = None

    def eval(self, row, threshold: float):
        m = re.search(r"(\d{4}-\d\d-\d\d)[T ](\d\d:\d\d:\d\d(?:[.,]\d{1,6})?)", row["text"] or "")
        if m is None:
            return
        try:
            now = datetime.datetime.fromisoformat(f"{m[1]} {m[2].replace(',', '.')}")
        except ValueError:
            return
        before, self.before = self.before, (row["line_no"], now)
        if before is not None:
            gap = abs((now - before[1]) / datetime.timedelta(seconds=1))
            if gap >= threshold:
                yield row["file"], row["line_no"], before[0], gap


def register_table_functions(spark: SparkSession, prefix: str = "log") -> None:
    """Table functions for SQL over any table of lines: ``<prefix>_matches``, ``_level`` and ``_gaps``.  They stream
    over their argument's rows; the caller's PARTITION BY says which rows one task sees in order."""
    for name, cls, result in (
        ("matches", LogMatches, "file string, line_no long, column int, length int, text string"), ("level", LogLevel, "file string, line_no long, text string"),
        ("gaps", LogGaps, "file string, line_no long, prev_line long, gap_seconds double"),
    ):
        spark.udtf.register(f"{prefix}_{name}", F.udtf(cls, returnType=result))


#: Marks that hold a span together, opening and closing.
BRACKETS = (("[", "]"), ("(", ")"), ("<", ">"), ('"', '"'))


def spans_of(sample: str) -> list[tuple[int, int]]:
    """Spans of a line: what stands in brackets or quotes, and words between white space; a colon
    or comma at a word's end belongs to none."""
    inner = "|".join(rf"{re.escape(a)}[^{re.escape(a + b)}]*{re.escape(b)}" for a, b in BRACKETS)
    out = []
    for m in re.finditer(rf"{inner}|[^\s{re.escape(''.join(a for a, _ in BRACKETS))}]+", sample):
        start, end = m.span()
        if any(m[0].startswith(a) and m[0].endswith(b) and end - start > 1 for a, b in BRACKETS):
            start, end = start + 1, end - 1
        while end > start and sample[end - 1] in ":,;":
            end -= 1
        if end > start:
            out.append((start, end))
    return out


def vote_spans(lines: DataFrame, least: float = 0.5) -> tuple[str, dict[str, tuple[int, int]]] | None:
    """An example line and its spans, by a vote of all lines: each line's skeleton is its first
    spans' shapes with what stands between them; the longest skeleton that at least ``least`` of the lines begin
    with wins, and the least line of it is the example.  None if no skeleton has as many.
    """
    depth = 12
    found = lines.where(F.trim("text") != "").mapInArrow(_skeletons(depth), "depth int, skeleton string, text string")
    votes = found.groupBy("depth", "skeleton").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.length("text").alias("l"), F.col("text"))).alias("example"))
    total = found.where("depth = 1").count()
    best = votes.where(F.col("n") >= least * total).orderBy(F.desc("depth"), F.desc("n"), "skeleton").head(1) if total else []
    if not best:
        return None
    sample, spans = best[0]["example"]["text"], spans_of(best[0]["example"]["text"])[: best[0]["depth"]]
    if best[0]["depth"] < depth and spans and spans[-1][1] < len(sample):  # what follows is the message
        rest = re.compile(r"[^\w]*").match(sample, spans[-1][1]).end()
        if rest < len(sample):
            spans.append((rest, len(sample)))
    return sample, {f"c{k + 1}": s for k, s in enumerate(spans)}


def _skeletons(depth: int):
    """Rows of text to each line's skeletons of 1 to ``depth`` spans, with the line cut to a bounded length."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text, skeleton, at = text[:400], "", 0
                for k, (start, end) in enumerate(spans_of(text)[:depth]):
                    shape = next((i for i, s in enumerate(SHAPES[:-3]) if re.fullmatch(s, text[start:end])), "w")
                    skeleton += re.sub(r"\s+", " ", text[at:start]) + f"{{{shape}}}"
                    at = end
                    out.append((k + 1, skeleton, text))
            columns = zip(*out, strict=True) if out else ([], [], [])
            kinds = (pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["depth", "skeleton", "text"])

    return run


#: Shapes of an example's spans, the first that fits.
SHAPES = [
    r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", r"\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", r"\d{1,3}(?:\.\d{1,3}){3}",
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"0x[0-9a-fA-F]+", r"[+-]?\d+", r"[+-]?\d+\.\d+", r"\w+", r"\S+",
]


def columns_by_example(lines: DataFrame, sample: str | None = None, spans: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    """Columns of the whole log from one example line with marked spans: each span's shape becomes
    the pattern there; what all values share at their start and end is peeled off.  Without spans the
    example's are split at white space and brackets; without an example both are voted from all
    lines (see :func:`vote_spans`), and lines without a common shape give no columns."""
    if sample is None:
        voted = vote_spans(lines)
        if voted is None:
            return lines.select(*KEY)
        sample, spans = voted
    if spans is None:
        spans = {f"c{k + 1}": s for k, s in enumerate(spans_of(sample))}
    pattern, at = "", 0
    for start, end in spans.values():
        gap = re.escape(re.sub(r"\s+", " ", sample[at:start])).replace(r"\ ", r"\s+")
        shape = next((s for s in SHAPES if re.fullmatch(s, sample[start:end])), ".+?")
        pattern += f"{gap}({shape})"
        at = end
    if pattern.endswith("(.+?)"):  # a last span of any shape goes to what follows it, or to the end
        pattern = pattern + re.escape(sample[at]) if at < len(sample) else pattern.removesuffix("(.+?)") + "(.+)"
    rows = lines.select(*KEY, *parse.pattern_columns("text", pattern, list(spans)))
    ends = []
    for n in spans:
        c = F.col(n)
        ends += [F.length(trend.same_column(c)).alias(f"_p_{n}"), F.length(trend.same_column(F.reverse(c))).alias(f"_s_{n}"), F.min(F.length(c)).alias(f"_l_{n}")]
    shared = rows.agg(*ends)
    joined = rows.join(F.broadcast(shared))

    def peeled(n: str) -> F.Column:
        # Only marks are a wrapper, not letters that all values happen to share.
        marks = lambda text, shared: F.length(F.regexp_extract(F.substr(text, F.lit(1), shared), r"^\W*", 0))
        p, s = marks(F.col(n), F.col(f"_p_{n}")), marks(F.reverse(F.col(n)), F.col(f"_s_{n}"))
        return F.when(p + s < F.col(f"_l_{n}"), F.substr(F.col(n), p + 1, F.length(n) - p - s)).otherwise(F.col(n)).alias(n)

    return joined.select(*KEY, *[peeled(n) for n in spans])


def evidence_pack(lines: DataFrame, gap: float = 60, k: int = 10, base: DataFrame | None = None) -> DataFrame:
    """One row for each file: the triage with its top components, longest gaps and fields, and the
    findings against another log if one is given."""
    top = lambda rows, order, *cols: rows.groupBy("file").agg(F.slice(F.sort_array(F.collect_list(F.struct(order, *cols)), asc=False), 1, k).alias("v"))
    failing = top(profile.top_failing(lines, k), "errors", "component", "first_error").withColumnRenamed("v", "components")
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("gap_seconds"), "line_no"))
    gaps = top(sequence.time_gaps(lines, gap).withColumn("_r", rank).where(F.col("_r") <= k), "gap_seconds", "line_no").withColumnRenamed("v", "silences")
    fields = trend.discover_fields(lines).orderBy(F.desc("occurrences"), "name").limit(k).agg(F.collect_list(F.struct("name", "type", "occurrences")).alias("fields"))
    pack = profile.triage(lines, gap).join(failing, "file", "left").join(gaps, "file", "left").join(F.broadcast(fields))
    if base is not None:
        findings = profile.compare_profiles(lines, base).agg(F.array_sort(F.collect_list(F.struct("severity", "category", "subject"))).alias("findings"))
        pack = pack.join(F.broadcast(findings))
    return pack


def compare_windows(lines: DataFrame, current: tuple[int, int], base: tuple[int, int]) -> DataFrame:
    """Two ranges of one log compared as if they were two runs."""
    from .search import scope_range

    return profile.compare_profiles(scope_range(lines, *current), scope_range(lines, *base))
