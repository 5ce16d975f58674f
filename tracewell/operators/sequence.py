"""Gaps, cadence, transitions and other verbs over the order of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, parse
from ..sources.store import store
from .ordered import CHUNK, Scan
from .quantiles import middles

KEY = ["file", "line_no"]


def timed(lines: DataFrame) -> DataFrame:
    """Lines that carry a time, with ``ts`` and ``ms``."""
    return lines.withColumn("ts", facts.ts(lines)).where(F.col("ts").isNotNull()).withColumn("ms", parse.epoch_ms("ts"))


def time_gaps(lines: DataFrame, threshold: float = 30, chunk: int = CHUNK) -> DataFrame:
    """Silences: consecutive timed lines at least ``threshold`` seconds apart, either way."""
    preview = F.when(F.length("text") > 80, F.concat(F.substring("text", 1, 80), F.lit("..."))).otherwise(F.col("text"))
    rows = timed(lines).select(*KEY, "ts", "ms", preview.alias("preview"), F.struct("line_no", "ms").alias("_here"))
    before = Scan(rows, chunk=chunk).lag("_here", "_prev")
    gap = F.abs(F.col("ms") - F.col("_prev.ms")) / 1000
    return before.where(gap >= threshold).select(*KEY, F.col("_prev.line_no").alias("prev_line"), gap.alias("gap_seconds"), "ts", "preview")


def bounded_gaps(lines: DataFrame, threshold: float, start_pattern: str, end_pattern: str, chunk: int = CHUNK) -> DataFrame:
    """Gaps from the first line with the start pattern to the first later or equal one with the end."""
    first = lines.where(F.contains("text", F.lit(start_pattern))).groupBy("file").agg(F.min("line_no").alias("_a"))
    scoped = lines.join(first, "file").where("line_no >= _a")
    last = scoped.where(F.contains("text", F.lit(end_pattern))).groupBy("file").agg(F.min("line_no").alias("_b"))
    scoped = scoped.join(last, "file", "left").where("_b is null or line_no <= _b")
    return time_gaps(scoped.select(*lines.columns), threshold, chunk)


def arrivals(lines: DataFrame, pattern: str, chunk: int = CHUNK) -> DataFrame:
    """Timed lines that contain a text, with the milliseconds since the one before."""
    rows = timed(lines.where(F.contains("text", F.lit(pattern))))
    return Scan(rows, chunk=chunk).lag("ms", "_prev").withColumn("delta_ms", F.col("ms") - F.col("_prev")).drop("_prev")


def cadence(lines: DataFrame, pattern: str, chunk: int = CHUNK) -> DataFrame:
    """Period of a heartbeat: median, least and most positive interval, expected number."""
    return _cadence(store(arrivals(lines, pattern, chunk).select(*KEY, "ms", "delta_ms"), "arrivals"))


def _cadence(seen: DataFrame) -> DataFrame:
    positive = F.when(F.col("delta_ms") > 0, F.col("delta_ms"))
    out = seen.groupBy("file").agg(
        F.count(F.lit(1)).alias("occurrences"), (F.min(positive) / 1000).alias("min_interval"), (F.max(positive) / 1000).alias("max_interval"),
        ((F.max("ms") - F.min("ms")) / 1000).alias("span"),
    )
    period = middles(seen, ["file"], positive).select("file", ((F.col("low") + F.col("high")) / 2000).alias("period"))
    expected = F.when(F.col("occurrences") >= 3, F.floor(F.round(F.col("span") / F.col("period"), 6) + 0.5).cast("long") + 1)
    return out.join(period, "file", "left").select("file", "occurrences", "period", "min_interval", "max_interval", "span", expected.alias("expected"))


def cadence_misses(lines: DataFrame, pattern: str, tolerance: float = 1.5, chunk: int = CHUNK) -> DataFrame:
    """Intervals of at least ``tolerance`` periods, and how many beats are missing in each."""
    seen = store(arrivals(lines, pattern, chunk).select(*KEY, "ms", "delta_ms"), "arrivals")
    periods = _cadence(seen).where("occurrences >= 3").select("file", "period")
    late = seen.join(periods, "file").withColumn("interval", F.col("delta_ms") / 1000).where(F.col("interval") >= F.col("period") * tolerance)
    missing = F.greatest(F.lit(1), F.floor(F.round(F.col("interval") / F.col("period"), 9) + 0.5).cast("long") - 1)
    return late.select(*KEY, "interval", missing.alias("missing"))


def cadence_drift(lines: DataFrame, pattern: str, chunk: int = CHUNK) -> DataFrame:
    """Median interval of the first and the last third; needs six intervals."""
    seen = store(arrivals(lines, pattern, chunk).where("delta_ms > 0").select(*KEY, "delta_ms"), "arrivals")
    ranked = Scan(seen, chunk=chunk).number("n")
    total = seen.groupBy("file").agg(F.count(F.lit(1)).alias("total"))
    third = F.floor(F.col("total") / 3)
    rows = ranked.join(total, "file").where("total >= 6")
    part = F.when(F.col("n") < third, "early").when(F.col("n") >= F.col("total") - third, "late")
    middle = middles(rows.withColumn("part", part).where("part is not null"), ["file", "part"], "delta_ms")
    of = lambda name: F.max(F.when(F.col("part") == name, (F.col("low") + F.col("high")) / 2)).alias(f"{name}_ms")
    return middle.groupBy("file").agg(of("early"), of("late"))


def carry_forward(rows: DataFrame, column: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """The last known value; leading rows take the file's first; all null without any."""
    filled = Scan(rows, chunk=chunk).last_known(column, "_before")
    first = rows.groupBy("file").agg(F.min_by(column, F.when(F.col(column).isNotNull(), F.col("line_no"))).alias("_first"))
    return filled.join(first, "file").withColumn(out, F.coalesce("_before", "_first")).drop("_before", "_first")


def even_sample(rows: DataFrame, k: int, chunk: int = CHUNK, by: tuple[str, ...] = ("file",)) -> DataFrame:
    """k rows of each group spread evenly: those numbered floor(i * n / k); all if there are fewer."""
    ranked = Scan(rows, by=by, chunk=chunk).number("_r")
    n = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    up = F.expr(f"(_r * {k} + _n - 1) div _n")
    spread = (up * F.col("_n") < (F.col("_r") + 1) * k) & (up < k)
    return ranked.join(n, list(by)).where((F.col("_n") <= k) | spread).drop("_r", "_n")


def transitions(rows: DataFrame, value: Column, chunk: int = CHUNK) -> DataFrame:
    """Rows whose value differs from the one before it that has a value."""
    known = rows.withColumn("to_value", value).where(F.col("to_value").isNotNull())
    before = Scan(known, chunk=chunk).lag("to_value", "from_value")
    return before.where(F.col("from_value") != F.col("to_value")).select(*KEY, "from_value", "to_value")


def escalations(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Lines whose level rises against the component's levelled line before."""
    rows = lines.select(*KEY, facts.component(lines).alias("component"), facts.level(lines).alias("level")).where("component is not null and level is not null")
    before = Scan(rows, by=("file", "component"), chunk=chunk).lag("level", "from_level")
    rises = ((F.col("from_level") == "info") & F.col("level").isin("warning", "error")) | ((F.col("from_level") == "warning") & (F.col("level") == "error"))
    return before.where(rises).select(*KEY, "component", "from_level", F.col("level").alias("to_level"))


def spread_equal_times(rows: DataFrame, chunk_ms: int = 86_400_000, chunk: int = CHUNK) -> DataFrame:
    """Rows (line_no, ms) of one time spread in order over 0.85 of the way to the next time;
    the last time stays."""
    groups = rows.groupBy("ms").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Scan(groups.withColumn("file", F.lit("")).withColumn("_neg", -F.col("ms")), order="_neg", chunk=chunk_ms).lag("ms", "_next").drop("file", "_neg")
    ranked = Scan(rows, by=("ms",), chunk=chunk).number("_r")
    x = F.col("ms") + F.col("_r") / F.col("_n") * (F.col("_next") - F.col("ms")) * 0.85
    return ranked.join(ahead, "ms").select("line_no", "ms", F.coalesce(x, F.col("ms").cast("double")).alias("spread_ms"))


def repair_monotonic(rows: DataFrame, column: str, low: int, high: int, chunk: int = CHUNK) -> DataFrame:
    """Times out of range take the last good one, and none lies before an earlier one."""
    good = rows.withColumn("_good", F.when(F.col(column).between(low, high), F.col(column)))
    return Scan(good, chunk=chunk).running_max("_good", "repaired").drop("_good")


def display_index(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    return Scan(rows, chunk=chunk).number("display_index")


def monotonicity(rows: DataFrame, column: str, chunk: int = CHUNK) -> DataFrame:
    """Share of consecutive pairs that do not fall."""
    known = rows.where(F.col(column).isNotNull())
    before = Scan(known, chunk=chunk).lag(column, "_prev").where(F.col("_prev").isNotNull())
    return before.groupBy("file").agg(F.round(F.avg((F.col(column) >= F.col("_prev")).cast("double")), 6).alias("monotone"), F.count(F.lit(1)).alias("pairs"))


def runs(rows: DataFrame, state: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Consecutive line numbers, of equal state if one is named, as start and count."""
    here = rows.withColumn("_state", F.col(state).cast("string") if state else F.lit(""))
    here = here.withColumn("_at", F.struct("line_no", "_state"))
    before = Scan(here, chunk=chunk).lag("_at", "_prev")
    new = ~F.coalesce((F.col("_prev.line_no") == F.col("line_no") - 1) & F.col("_prev._state").eqNullSafe(F.col("_state")), F.lit(False))
    marked = before.withColumn("_new", new.cast("long"))
    island = Scan(marked, chunk=chunk).running_sum("_new", "island")
    out = island.groupBy("file", "island").agg(F.min("line_no").alias("start_line"), F.count(F.lit(1)).alias("lines"), F.first("_state").alias("state"))
    return out.drop("island") if state else out.drop("island", "state")
