"""Profiles of a log: levels, crashes, components, density, baselines and their comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, parse
from .sequence import time_gaps

KEY = ["file", "line_no"]


def analysed(lines: DataFrame) -> DataFrame:
    """Lines that count: neither blank nor comments, with level and component."""
    some = lines.where((F.trim("text") != "") & ~F.ltrim("text").startswith("#"))
    return some.withColumns({"level": facts.analysed_level(lines), "component": facts.component(lines)})


def level_counts(lines: DataFrame) -> DataFrame:
    """Lines by file and level, zero-filled, with the percentage of all counted lines."""
    rows = analysed(lines)
    n = {x: F.count_if(F.col("level") == x).alias(x) for x in parse.LEVELS}
    wide = rows.groupBy("file").agg(F.count(F.lit(1)).alias("_all"), *n.values())
    long = wide.select("file", "_all", F.explode(F.array(*[F.struct(F.lit(x).alias("level"), F.col(x).alias("lines")) for x in parse.LEVELS])).alias("e"))
    return long.select("file", "e.level", "e.lines", F.round(F.col("e.lines") * 100 / F.col("_all"), 2).alias("percent"))


def crash_sites(lines: DataFrame, limit: int | None = None) -> DataFrame:
    """Lines with a crash word, in their ``message`` if they have such a column (see
    :func:`.columns.by_role`), else in the whole line."""
    word = parse.crash_keyword("message") if "message" in lines.columns else facts.crash(lines)
    out = analysed(lines).withColumn("keyword", word).where("keyword is not null").select(*KEY, "keyword", "level", "component", "text")
    return out.orderBy(*KEY).limit(limit) if limit else out


def crashes_by_keyword(lines: DataFrame) -> DataFrame:
    return crash_sites(lines).groupBy("file", "keyword").agg(F.count(F.lit(1)).alias("crashes"), F.min("line_no").alias("first_line"), F.min_by("text", "line_no").alias("sample"))


def component_errors(lines: DataFrame) -> DataFrame:
    rows = analysed(lines).where("component is not null")
    error, warning = F.col("level").isin("error", "fatal"), F.col("level") == "warning"
    return rows.groupBy("file", "component").agg(F.count_if(error).alias("errors"), F.count_if(warning).alias("warnings"), F.min(F.when(error, F.col("line_no"))).alias("first_error"), F.count(F.lit(1)).alias("lines"))


def top_failing(lines: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("errors"), "component"))
    return component_errors(lines).where("errors > 0").withColumn("_r", rank).where(F.col("_r") <= k).drop("_r", "lines")


def component_rollup(lines: DataFrame) -> DataFrame:
    """Lines by file, component and level, with subtotals."""
    return analysed(lines).rollup("file", "component", "level").agg(F.count(F.lit(1)).alias("lines"), F.grouping_id().alias("grouping"))


def time_span(lines: DataFrame) -> DataFrame:
    rows = lines.select("file", "line_no", parse.ts_str("text").alias("s")).where("s is not null")
    return rows.groupBy("file").agg(F.min_by("s", "line_no").alias("first_ts"), F.max_by("s", "line_no").alias("last_ts"))


def level_density(lines: DataFrame, buckets: int) -> DataFrame:
    """Lines by level in so many position buckets."""
    total = lines.groupBy("file").agg((F.max("line_no") + 1).alias("_n"))
    rows = analysed(lines).where("level is not null").join(total, "file")
    return rows.groupBy("file", F.floor(F.col("line_no") * buckets / F.col("_n")).cast("long").alias("bucket"), "level").agg(F.count(F.lit(1)).alias("lines"))


def severity_ticks(lines: DataFrame, buckets: int) -> DataFrame:
    total = lines.groupBy("file").agg((F.max("line_no") + 1).alias("_n"))
    bucket = F.floor(F.col("line_no") * buckets / F.col("_n")).cast("long").alias("bucket")
    return lines.join(total, "file").groupBy("file", bucket).agg(F.max(facts.severity(lines)).alias("rank"))


def severity_counts(lines: DataFrame) -> DataFrame:
    rank = facts.severity(lines)
    return lines.groupBy("file").agg(F.count_if(rank == 3).alias("fatal"), F.count_if(rank == 2).alias("error"), F.count_if(rank == 1).alias("warning"))


def filter_suggestions(lines: DataFrame) -> DataFrame:
    """Filters worth trying, a row for each, by file."""
    level = F.col("level")
    sums = analysed(lines).groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(level == "error").alias("e"), F.count_if(level == "warning").alias("w"), F.count_if(level.isin("debug", "trace")).alias("d")
    )
    e, w, d, n = (F.col(x) for x in "ewdn")
    rules = F.array(
        F.when((e > 0) & (e < n * 0.5), F.struct(F.lit("filter-errors-only").alias("id"), e.alias("lines"))),
        F.when((e + w > 0) & (e + w < n * 0.5), F.struct(F.lit("filter-errors-warnings").alias("id"), (e + w).alias("lines"))),
        F.when((n > 0) & (d > n * 0.3), F.struct(F.lit("filter-no-debug").alias("id"), d.alias("lines"))),
    )
    by_file = sums.select("file", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("s")).select("file", "s.id", "s.lines")
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("errors"), "component"))
    by_component = component_errors(lines).where("errors > 5").withColumn("_r", rank).where("_r <= 3").select("file", F.concat(F.lit("filter-component-"), "component").alias("id"), F.col("errors").alias("lines"))
    return by_file.unionByName(by_component)


def merge_analysis(lines: DataFrame, k: int = 5) -> DataFrame:
    """Components over all files together: sums and the first error's file and line."""
    parts = component_errors(lines)
    first = F.min(F.when(F.col("first_error").isNotNull(), F.struct("file", "first_error"))).alias("_f")
    whole = parts.groupBy("component").agg(F.sum("errors").alias("errors"), F.sum("warnings").alias("warnings"), first).where("errors > 0")
    return whole.orderBy(F.desc("errors"), "component").limit(k).select("component", "errors", "warnings", F.col("_f.file").alias("file"), F.col("_f.first_error").alias("first_error"))


def minute_density(lines: DataFrame, most: int | None = None) -> DataFrame:
    """Lines by minute since the first line's time, zero-filled, to the last minute or for at
    ``most`` so many; lines timed before the first line are dropped.

    Lines are counted by second in one pass; the first line's second shifts these sums.
    """
    counts = busy_minutes(lines, most)
    # by days first, as one wrong year makes millions of minutes
    days = counts.groupBy("file").agg(F.max("minute").alias("_m")).select("file", "_m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_m") / 1440))).alias("_d"))
    span = days.select("file", F.explode(F.sequence(F.col("_d") * 1440, F.least("_m", F.col("_d") * 1440 + 1439))).alias("minute"), F.lit(0).cast("long").alias("lines"))
    return counts.unionByName(span).groupBy("file", "minute").agg(F.sum("lines").alias("lines"))


def busy_minutes(lines: DataFrame, most: int | None = None) -> DataFrame:
    """:func:`minute_density` without the minutes that have no line."""
    seconds = F.unix_seconds(parse.parse_ts_seconds("text").cast("timestamp")).alias("s")
    by_second = lines.select("file", "line_no", seconds).where("s is not null").groupBy("file", "s").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("line_no"))
    start = by_second.groupBy("file").agg(F.min_by("s", "line_no").alias("_t0"))
    minute = F.floor((F.col("s") - F.col("_t0")) / 60).cast("long")
    kept = F.col("minute") >= 0 if most is None else F.col("minute").between(0, most - 1)
    return by_second.join(start, "file").withColumn("minute", minute).where(kept).groupBy("file", "minute").agg(F.sum("n").alias("lines"))


def component_counts(lines: DataFrame) -> DataFrame:
    c = parse.bracket_component("text")
    return lines.withColumn("component", c).where("component is not null").groupBy("file", "component").agg(F.count(F.lit(1)).alias("lines"))


def level_samples(lines: DataFrame, k: int = 10) -> DataFrame:
    """The first line of each level in each of k stripes of the log."""
    total = lines.groupBy("file").agg((F.max("line_no") + 1).alias("_n"))
    rows = analysed(lines).where("level is not null").join(total, "file")
    stripe = F.least(F.lit(k - 1), F.floor(F.col("line_no") * k / F.col("_n"))).cast("long").alias("stripe")
    return rows.groupBy("file", "level", stripe).agg(F.min("line_no").alias("line_no"))


def component_samples(lines: DataFrame, k: int = 5) -> DataFrame:
    rows = analysed(lines).where("component is not null and level in ('error', 'warning')")
    first = F.row_number().over(Window.partitionBy("file", "component").orderBy("line_no"))
    return rows.withColumn("_r", first).where(F.col("_r") <= k).select("file", "component", "line_no", "level")


def tallies(lines: DataFrame) -> DataFrame:
    """Lines that count by file, component, level and crash word: what levels, crashes, failing
    components and totals are sums of, from one pass.  It has few rows, however long the log."""
    return analysed(lines).withColumn("crash", facts.crash(lines)).groupBy("file", "component", "level", "crash").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


def _of(tallied: DataFrame, when: Column) -> Column:
    return F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))


def fingerprint(lines: DataFrame, samples: int = 5) -> DataFrame:
    """One row for each file: total, levels, components, failing ones, crash words, density
    (``minutes`` in all, and those that have lines), and the first lines of errors and crashes as samples."""
    as_map = lambda key, value: F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))
    seen = tallies(lines)
    bad = F.col("level").isin("error", "fatal")
    total = lines.groupBy("file").agg(F.count(F.lit(1)).alias("total_lines"))
    by_level = F.map_from_arrays(F.array(*map(F.lit, parse.LEVELS)), F.array(*[_of(seen, F.col("level") == x) for x in parse.LEVELS]))
    sums = seen.groupBy("file").agg(by_level.alias("levels"), F.array_sort(F.collect_set("crash")).alias("crashes"))
    named = seen.where("component is not null").groupBy("file", "component").agg(_of(seen, bad).alias("errors"))
    failing = named.where("errors > 0").groupBy("file").agg(as_map("component", "errors").alias("failing"))
    parts = component_counts(lines).groupBy("file").agg(as_map("component", "lines").alias("components"))
    density = busy_minutes(lines).groupBy("file").agg((F.max("minute") + 1).alias("minutes"), F.array_sort(F.collect_list(F.struct("minute", "lines"))).alias("density"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy("first_line"))
    shown = seen.where(bad | F.col("crash").isNotNull()).withColumn("_r", rank).where(F.col("_r") <= samples).groupBy("file").agg(F.array_sort(F.collect_list("first_line")).alias("samples"))
    out = total
    for more in (time_span(lines), sums, parts, failing, density, shown):
        out = out.join(more, "file", "left")
    return out


def compare_profiles(current: DataFrame, base: DataFrame, most: int | None = None) -> DataFrame:
    """Findings between two logs (each ``lines`` of one run), most severe first; density is of
    all minutes, or of ``most``."""
    seen = [tallies(x) for x in (current, base)]
    shares = []
    for x, n in zip(seen, "cb", strict=True):
        total = x.agg(F.sum("n").alias("_t"))
        shares.append(x.where("level is not null").groupBy("level").agg(F.sum("n").alias("_l")).join(F.broadcast(total)).select("level", (F.col("_l") * 100 / F.col("_t")).alias(n)))
    levels = shares[0].join(shares[1], "level", "full")
    delta = F.abs(F.coalesce("c", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))
    found = levels.where(delta > 5).select(F.when(delta > 15, "critical").otherwise("warning").alias("severity"), F.lit("level-shift").alias("category"), F.col("level").alias("subject"))
    words = [x.where("crash is not null").select("crash").distinct() for x in seen]
    new_crash = words[0].join(words[1], "crash", "left_anti")
    found = found.unionByName(new_crash.select(F.lit("critical").alias("severity"), F.lit("new-crash").alias("category"), F.col("crash").alias("subject")))
    bad = F.col("level").isin("error", "fatal")
    cc, cb = (x.where("component is not null").groupBy("component").agg(_of(x, bad).alias("e"), F.sum("n").alias("n")) for x in seen)
    new_failing = cc.where("e > 0").join(cb.where("e > 0"), "component", "left_anti").select(F.lit("warning").alias("severity"), F.lit("new-component").alias("category"), F.col("component").alias("subject"))
    gone = cb.where("n > 10").join(cc, "component", "left_anti").select(F.lit("info").alias("severity"), F.lit("missing-component").alias("category"), F.col("component").alias("subject"))
    ratio = F.col("ce") / F.col("be")
    rate = cc.select("component", F.col("e").alias("ce")).join(cb.where("e > 0").select("component", F.col("e").alias("be")), "component").where(ratio > 2)
    rate = rate.select(F.when(ratio > 5, "critical").otherwise("warning").alias("severity"), F.lit("error-rate").alias("category"), F.col("component").alias("subject"))
    var = lambda x, n: minute_density(x, most).agg(F.var_pop("lines").alias(n))
    v = F.greatest("c", "b") / F.least("c", "b")
    shape = var(current, "c").join(F.broadcast(var(base, "b"))).where((F.least("c", "b") > 0) & (v > 3)).select(F.lit("info").alias("severity"), F.lit("density").alias("category"), F.lit("variance").alias("subject"))
    for more in (new_failing, gone, rate, shape):
        found = found.unionByName(more)
    return found


def verdict(findings: DataFrame) -> DataFrame:
    c, w = F.count_if(F.col("severity") == "critical"), F.count_if(F.col("severity") == "warning")
    return findings.agg(F.when(c > 2, "significantly-degraded").when((c > 0) | (w > 0), "degraded").when(F.count(F.lit(1)) > 0, "improved").otherwise("stable").alias("verdict"), c.alias("critical"), w.alias("warnings"))


def triage(lines: DataFrame, gap: float = 60) -> DataFrame:
    """One row for each file: counts and the severity that follows from them."""
    seen, bad = tallies(lines), F.col("level").isin("error", "fatal")
    by_part = seen.groupBy("file", "component").agg(
        F.sum("n").alias("n"), _of(seen, bad).alias("e"), _of(seen, F.col("level") == "warning").alias("w"), _of(seen, F.col("crash").isNotNull()).alias("c")
    )
    sums = by_part.groupBy("file").agg(
        F.sum("n").alias("lines"), F.sum("e").alias("errors"), F.sum("w").alias("warnings"), F.sum("c").alias("crashes"),
        F.count_if((F.col("e") > 0) & F.col("component").isNotNull()).alias("failing"),
    )
    gaps = time_gaps(lines, gap).groupBy("file").agg(F.count(F.lit(1)).alias("gaps"), F.max("gap_seconds").alias("longest_gap"))
    out = sums.join(gaps, "file", "left")
    zero = out.fillna(0)
    percent = F.col("errors") * 100 / F.col("lines")
    severity = F.when((F.col("crashes") > 0) | (percent > 20), "critical").when((percent > 5) | (F.col("longest_gap") > 300) | (F.col("failing") > 3), "warning").otherwise("ok")
    return zero.withColumn("severity", severity).withColumn("error_percent", F.round(percent, 4))


def conclude(lines: DataFrame, marks: DataFrame | None = None, most: int = 40) -> DataFrame:
    """The events that matter on one timeline: crashes, each component's first error, the five
    longest gaps, and marks; the first of them (not a mark) is the likely trigger."""
    kind = lambda x: F.lit(x).alias("kind")
    events = crash_sites(lines).select(*KEY, kind("crash"), F.col("keyword").alias("detail"))
    errors = component_errors(lines).where("errors > 0").select("file", F.col("first_error").alias("line_no"), kind("first-error"), F.col("component").alias("detail"))
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("gap_seconds"), "line_no"))
    gaps = time_gaps(lines, 30).withColumn("_r", rank).where("_r <= 5").select(*KEY, kind("gap"), parse.duration_text("gap_seconds").alias("detail"))
    events = events.unionByName(errors).unionByName(gaps)
    if marks is not None:
        events = events.unionByName(marks.select(*KEY, kind("mark"), F.col("note").alias("detail")))
    place = F.row_number().over(Window.partitionBy("file").orderBy("line_no", "kind", "detail"))
    return events.withColumn("place", place).where(F.col("place") <= most)


def conclusion_verdict(lines: DataFrame) -> DataFrame:
    """crash, error-storm, stall, warnings or clean, with the first anomaly's line."""
    t = triage(lines, 30)  # silences of half a minute count as stalls
    rate = F.col("errors") * 100 / F.col("lines")
    v = F.when(F.col("crashes") > 0, "crash").when((rate >= 5) | (F.col("errors") >= 5), "error-storm").when(F.col("gaps") > 0, "stall").when(F.col("warnings") > 0, "warnings").otherwise("clean")
    first = conclude(lines).where("place = 1").select("file", F.col("line_no").alias("first_anomaly"), F.col("kind").alias("first_kind"))
    return t.select("file", v.alias("verdict"), "errors", "warnings").join(first, "file", "left")
