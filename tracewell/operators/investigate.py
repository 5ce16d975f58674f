"""Reports about a log, a component or a span of time, as rows of sections.

Every report has the columns ``(file, section, place, item, n, line_no)``: ``place`` orders a
section's rows, ``n`` counts where something is counted, ``line_no`` is where to look.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, parse
from ..sources import readers
from . import profile, proximity, search, sequence, trend

REPORT = ["file", "section", "place", "item", "n", "line_no"]
# Markers of errors in an unknown log.
ERROR_MARKERS = "error|fatal|exception|panic|segfault|traceback|fail(ed|ure)?|crash|OOM|out of memory"


def _section(rows: DataFrame, name: str, item: Column, n: Column | None = None, line_no: Column | None = None, place: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("long")
    return rows.select(
        "file", F.lit(name).alias("section"), (place if place is not None else F.lit(1)).cast("int").alias("place"), item.cast("string").alias("item"),
        (n if n is not None else none).cast("long").alias("n"), (line_no if line_no is not None else none).cast("long").alias("line_no"),
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _top(counts: DataFrame, key: str, k: int) -> DataFrame:
    """The k most frequent of each file, with their place."""
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("n"), key))
    return counts.withColumn("place", rank).where(F.col("place") <= k)


def _level(lines: DataFrame) -> Column:
    return F.coalesce(facts.level(lines), F.lit("other"))


def preflight(lines: DataFrame, k: int = 5) -> DataFrame:
    """What kind of log each file is: shape, format, span, levels, the first k lines with error
    markers, and the k most frequent line shapes, tags and fields."""
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"))
    ts = parse.wall_clock(facts.ts(lines))
    span = lines.select("file", "line_no", ts.alias("ts")).where("ts is not null").groupBy("file").agg(
        F.struct(F.min_by("ts", "line_no").alias("ts"), F.min("line_no").alias("line_no")).alias("first"), F.struct(F.max_by("ts", "line_no").alias("ts"), F.max("line_no").alias("line_no")).alias("last")
    )
    first = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    # a file's first errors: a few lines of each chunk are enough to choose from
    marked = lines.where(F.col("text").rlike("(?i)" + ERROR_MARKERS)).select("file", "line_no", "text")
    few = marked.groupBy("file", F.floor(F.col("line_no") / 100_000).alias("_c")).agg(F.slice(F.array_sort(F.collect_list(F.struct("line_no", "text"))), 1, k).alias("e"))
    errors = few.select("file", F.explode("e").alias("e")).select("file", "e.line_no", "e.text").withColumn("place", first).where(F.col("place") <= k)
    count = lambda rows, key: _top(rows.groupBy("file", key).agg(F.count(F.lit(1)).alias("n")), key, k)
    repeats = count(lines.select("file", parse.noise_key("text").alias("key")), "key")
    tags = count(lines.select("file", facts.component(lines).alias("key")).where("key is not null"), "key")
    names = lines.select("file", F.explode(F.map_keys(parse.extract_fields("text"))).alias("key"))
    fields = count(names, "key")
    levels = lines.groupBy("file", _level(lines).alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no"))
    listed = lambda rows, name: _section(rows, name, F.col("key"), F.col("n"), place=F.col("place"))
    return _union([
        _section(sizes, "lines", F.col("n"), F.col("n")), _section(sizes, "longest", F.col("longest"), F.col("longest")),
        _section(readers.detect_format(lines), "format", F.col("format")),
        _section(span, "first time", F.col("first.ts"), line_no=F.col("first.line_no")), _section(span, "last time", F.col("last.ts"), line_no=F.col("last.line_no")),
        _section(levels, "level", F.col("level"), F.col("n"), F.col("line_no")),
        _section(errors, "first errors", F.col("text"), line_no=F.col("line_no"), place=F.col("place")),
        listed(repeats, "repeats"), listed(tags, "tags"), listed(fields, "fields"),
    ])


def component(lines: DataFrame, name: str, samples: int = 5, sites: int = 10, around: int = 5) -> DataFrame:
    """All that mentions a component: mentions by level, where it is first and last seen, evenly
    spread samples of each level, evenly spread error lines with the lines around them, and
    whether it is among the five that fail most."""
    seen = lines.where(F.contains(F.lower("text"), F.lit(name.lower())))
    seen = seen.select("file", "line_no", "text", _level(seen).alias("level"), parse.wall_clock(facts.ts(seen)).alias("ts"))
    levels = seen.groupBy("file", "level").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no"))
    span = seen.where("ts is not null").groupBy("file").agg(
        F.min("line_no").alias("a"), F.min_by("ts", "line_no").alias("first"), F.max("line_no").alias("b"), F.max_by("ts", "line_no").alias("last")
    )
    spread = sequence.even_sample(seen, samples, by=("file", "level"))
    errors = sequence.even_sample(seen.where("level = 'error'"), sites)
    context = proximity.context_windows(errors, lines, around)
    bare = name.strip("[]").lower()
    top = profile.top_failing(lines).where(F.lower("component") == bare)
    return _union([
        _section(levels, "level", F.col("level"), F.col("n"), F.col("line_no")),
        _section(span, "first seen", F.col("first"), line_no=F.col("a")), _section(span, "last seen", F.col("last"), line_no=F.col("b")),
        _section(spread, "sample", F.col("text"), line_no=F.col("line_no")),
        _section(context, "error site", F.col("context"), F.col("lines"), F.col("hit_line")),
        _section(top, "top failer", F.col("component"), F.col("errors"), F.col("first_error")),
    ])


def timerange(lines: DataFrame, start: str, end: str, samples: int = 20, edge: int = 5, gaps: int = 10) -> DataFrame:
    """What happened in a span of time: lines by level, lines with crash words, the longest
    silences of 30 seconds or more, the first and last lines, and evenly spread samples of errors
    and warnings."""
    some = search.time_window(lines, start, end)
    rows = some.select("file", "line_no", "text", _level(some).alias("level"))
    levels = rows.groupBy("file", "level").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no"))
    crashes = rows.withColumn("word", parse.crash_keyword("text", "list")).where("word is not null")
    silent = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("gap_seconds"), "line_no"))
    longest = sequence.time_gaps(some, 30).withColumn("place", silent).where(F.col("place") <= gaps)
    ends = rows.groupBy("file").agg(F.min("line_no").alias("a"), F.max("line_no").alias("b"))
    place = F.when(F.col("line_no") < F.col("a") + edge, F.col("line_no") - F.col("a") + 1)
    back = F.when(F.col("line_no") > F.col("b") - edge, F.col("b") - F.col("line_no") + 1)
    edges = rows.join(ends, "file")
    picked = sequence.even_sample(rows.where("level in ('error', 'warning')"), samples, by=("file", "level"))
    return _union([
        _section(levels, "level", F.col("level"), F.col("n"), F.col("line_no")),
        _section(crashes, "crash", F.col("word"), line_no=F.col("line_no")),
        _section(longest, "silence", parse.duration_text("gap_seconds"), line_no=F.col("line_no"), place=F.col("place")),
        _section(edges.where(place.isNotNull()), "first lines", F.col("text"), line_no=F.col("line_no"), place=place),
        _section(edges.where(back.isNotNull()), "last lines", F.col("text"), line_no=F.col("line_no"), place=back),
        _section(picked, "sample", F.concat_ws(": ", "level", "text"), line_no=F.col("line_no")),
    ])


def analyze(lines: DataFrame, k: int = 5) -> DataFrame:
    """The whole analysis by files: level counts, crash lines, failing components, span and
    suggested filters.  With ``message``, ``level_cell`` or ``component_cell`` columns, as
    :func:`..operators.columns.by_role` gives, these are read instead of the whole line."""
    has = set(lines.columns)
    rows = lines.where((F.trim("text") != "") & ~F.ltrim("text").startswith("#"))
    level = F.coalesce(*([parse.normalize_level(F.lower("level_cell"))] if "level_cell" in has else []), facts.analysed_level(lines))
    part = F.coalesce(*([parse.simplify_source("component_cell")] if "component_cell" in has else []), facts.component(lines))
    crash = parse.crash_keyword("message") if "message" in has else facts.crash(lines)
    rows = rows.select("file", "line_no", "text", level.alias("level"), part.alias("component"), crash.alias("crash"))
    bad = F.col("level").isin("error", "fatal")
    levels = rows.where("level is not null").groupBy("file", "level").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no"))
    words = rows.where("crash is not null").groupBy("file", "crash").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no"))
    parts = rows.where("component is not null").groupBy("file", F.col("component").alias("key")).agg(F.count_if(bad).alias("n"), F.min(F.when(bad, F.col("line_no"))).alias("line_no"))
    span = profile.time_span(lines)
    return _union([
        _section(levels, "level", F.col("level"), F.col("n"), F.col("line_no")), _section(words, "crash", F.col("crash"), F.col("n"), F.col("line_no")),
        _section(_top(parts.where("n > 0"), "key", k), "failing", F.col("key"), F.col("n"), F.col("line_no"), F.col("place")),
        _section(span, "first time", F.col("first_ts")), _section(span, "last time", F.col("last_ts")),
        _section(profile.filter_suggestions(lines), "filter", F.col("id"), F.col("lines")),
    ])
