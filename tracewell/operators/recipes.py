"""Reports for common questions, composed from the other verbs."""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..sources import readers
from ..sources.store import store
from . import profile, search, sequence, trend

KEY = ["file", "line_no"]

# Markers of each domain.
PACKS = {
    "generic": {
        "crash": "FATAL|exception|panic|stack ?trace|segfault|core dumped|uncaught|abort",
        "hang": "deadlock|hang|stuck|not responding|watchdog|timed? ?out",
        "startup": "failed to (start|load|init)|cannot find|missing|permission denied|EADDRINUSE|bind|config(uration)? error",
        "connection": "disconnect|reconnect|connection (refused|reset|lost|closed)|timeout|retry|broken pipe",
    },
    "android": {
        "crash": r"FATAL EXCEPTION|ANR |signal 11|tombstone|AndroidRuntime|Force ?Closing",
        "hang": r"ANR |Skipped \d+ frames|Choreographer|watchdog|not responding",
        "startup": "Unable to start|ClassNotFoundException|InflateException|permission denied|SecurityException",
        "connection": "NetworkOnMainThread|UnknownHostException|SocketTimeout|ConnectException|disconnected",
    },
    "embedded": {
        "crash": r"HardFault|assert(ion)? failed|panic|stack overflow|BusFault|UsageFault",
        "hang": "watchdog|WDT|reset|hang|stuck|spin",
        "startup": "boot fail|init fail|no (memory|heap)|flash error|peripheral .* fail",
        "connection": "link down|bus off|CAN error|timeout|NACK|no ack|reset",
    },
    "web": {
        "crash": r"traceback|unhandled (rejection|exception)|segfault|OOMKilled|fatal error|5\d\d ",
        "hang": "timeout|deadlock|pool exhausted|event loop blocked|slow query",
        "startup": "EADDRINUSE|cannot bind|ECONNREFUSED|env(ironment)? .* missing|migration failed|listen",
        "connection": "ECONNRESET|ETIMEDOUT|socket hang up|connection (refused|closed)|upstream",
    },
    "automotive": {
        "crash": "DTC|fault code|error frame|limp|MIL on",
        "hang": "no signal|stale|timeout|bus off",
        "startup": "ecu .* fail|calibration|no comm|init fail",
        "connection": "bus off|CAN error|lost frame|timeout|no response",
    },
}
# What tells a domain, and names of fields that hold a latency.
DETECT = {
    "android": r"\b(ActivityManager|AndroidRuntime|logcat|\bI/|\bE/|Choreographer)\b",
    "embedded": r"\b(HardFault|watchdog|WDT|bootloader|firmware|0x[0-9a-f]{8})\b",
    "web": r"\b(GET|POST|PUT|DELETE)\b .*\b[1-5]\d\d\b|\b(req_id|request_id|trace_id|upstream)\b",
    "automotive": r"\b(CAN|DTC|ECU|signal|MDF|channel group)\b",
}
SLOW_FIELDS = {
    "generic": ["duration", "elapsed", "latency", "took", "ms", "time_ms", "responsetime"],
    "android": ["Displayed", "duration", "ms", "frames"],
    "embedded": ["tick", "cycles", "us", "ms"],
    "web": ["latency_ms", "latency", "rt", "took", "duration", "response_time", "ms"],
    "automotive": ["rpm", "speed", "temp", "voltage"],
}


def detect_domain(lines: DataFrame, head: int | None = None) -> DataFrame:
    """The domain with the most hits in each file or its first ``head`` lines, generic below two."""
    if head is not None:
        lines = lines.where(F.col("line_no") < head)
    hits = F.array(*[F.struct(F.regexp_count("text", F.lit("(?i)" + p)).alias("n"), F.lit(d).alias("domain")) for d, p in DETECT.items()])
    rows = lines.select("file", F.explode(hits).alias("h")).groupBy("file", "h.domain").agg(F.sum("h.n").alias("hits"))
    best = rows.groupBy("file").agg(F.max_by("domain", F.struct("hits", F.col("domain"))).alias("best"), F.max("hits").alias("hits"))
    return best.select("file", F.when(F.col("hits") >= 2, F.col("best")).otherwise("generic").alias("domain"), "hits")


def _first(rows: DataFrame, most: int | None) -> DataFrame:
    """The first rows of each file, all of them without a limit."""
    if most is None:
        return rows
    rank = F.row_number().over(Window.partitionBy("file").orderBy("line_no"))
    return rows.withColumn("_r", rank).where(F.col("_r") <= most)


def markers(lines: DataFrame, pattern: str, title: str, severity: str, most: int | None = None) -> DataFrame:
    return _first(lines.where(F.col("text").rlike("(?i)" + pattern)), most).select(*KEY, F.lit(severity).alias("severity"), F.lit(title).alias("title"))


def crash(lines: DataFrame, domain: str = "generic") -> DataFrame:
    """The last crash line first of all, then the first line of each crash word; in files without
    a crash word, the lines with the domain's crash markers."""
    sites = profile.crash_sites(lines)
    last = sites.groupBy("file").agg(F.max("line_no").alias("line_no")).select(*KEY, F.lit("critical").alias("severity"), F.lit("final crash line").alias("title"))
    first = profile.crashes_by_keyword(lines).select("file", F.col("first_line").alias("line_no"), F.lit("error").alias("severity"), F.col("keyword").alias("title"))
    others = lines.join(sites.select("file").distinct(), "file", "left_anti")
    return last.unionByName(first).unionByName(markers(others, PACKS[domain]["crash"], "crash marker", "error"))


def hang(lines: DataFrame, most: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("file").orderBy(F.desc("gap_seconds"), "line_no"))
    gaps = sequence.time_gaps(lines, 30).withColumn("_r", rank).where(F.col("_r") <= most)
    return gaps.select(*KEY, F.lit("warning").alias("severity"), F.concat(F.lit("silence of "), parse.duration_text("gap_seconds")).alias("title"))


def slow(lines: DataFrame, field: str | None = None, most: int = 10, domain: str = "generic") -> DataFrame:
    """The highest values of a latency field; without one, slowness markers."""
    if field is None:
        hints = SLOW_FIELDS[domain]
        names = trend.discover_fields(lines).where("type = 'numeric'").select("name")
        rank = F.coalesce(*[F.when(F.contains(F.lower("name"), F.lit(h.lower())), k) for k, h in enumerate(hints)])
        field = names.select(rank.alias("rank"), "name").where("rank is not null").agg(F.min(F.struct("rank", "name"))["name"]).first()[0]
    if field is None:
        return markers(lines, "slow|timeout|timed out|GC pause|throttl", "slowness marker", "warning", most)
    return trend.largest(lines, field, most).select(*KEY, F.lit("warning").alias("severity"), F.format_string(f"{field} at %.2f", "value").alias("title"))


def error_storm(lines: DataFrame) -> DataFrame:
    return profile.top_failing(lines).select("file", F.col("first_error").alias("line_no"), F.lit("error").alias("severity"), F.concat(F.lit("first error of "), "component").alias("title"))


def wont_start(lines: DataFrame, domain: str = "generic") -> DataFrame:
    anchor = lines.where("line_no = 0").select(*KEY, F.lit("info").alias("severity"), F.lit("start of the log").alias("title"))
    return anchor.unionByName(markers(lines, PACKS[domain]["startup"], "start-up failure", "error"))


def connection_drops(lines: DataFrame, domain: str = "generic", most: int | None = None) -> DataFrame:
    return markers(lines, PACKS[domain]["connection"], "connection trouble", "warning", most)


def flips(lines: DataFrame, field: str, label: str = "flip", most: int | None = None) -> DataFrame:
    rows = _first(sequence.transitions(lines, parse.field("text", field)), most)
    return rows.select(*KEY, F.lit("warning").alias("severity"), F.concat(F.lit(f"{label}: {field} "), "from_value", F.lit(" -> "), "to_value").alias("title"))


def ui_state(lines: DataFrame, words: list[str] | None = None, most: int | None = None, expectation: str | None = None) -> DataFrame:
    """Where each expected word is logged, and how its value flips; with ``most``, about so many
    hits over all words and two flips of each.  Words may be given as a sentence that tells what
    was expected; its keywords are taken then."""
    if words is None:
        spark = lines.sparkSession
        words = spark.range(1).select(parse.keywords(F.lit(expectation or "")).alias("w")).first()["w"]
    per, flipped = (None, None) if most is None else (max(2, most // max(1, len(words))), 2)
    out = lines.where(F.lit(False)).select(*KEY, F.lit("").alias("severity"), F.lit("").alias("title"))
    for w in words:
        out = out.unionByName(markers(lines, re.escape(w), f'logged state "{w}"', "info", per)).unionByName(flips(lines, w, "state change", flipped))
    return out


#: What to look at next after a finding of a severity.
NEXT = {
    "critical": "what did the lines before it say, and which component wrote them?", "error": "is it the first of its kind, and what changed just before?",
    "warning": "does it come again at even times?", "info": "is anything missing that should follow?",
}


def report(findings: DataFrame, most: int = 10) -> DataFrame:
    """The first findings in order of line, with the range around each to look at and a question to
    go on with."""
    place = F.row_number().over(Window.partitionBy("file").orderBy("line_no", "title"))
    ask = F.coalesce(*[F.when(F.col("severity") == k, v) for k, v in NEXT.items()])
    return findings.withColumn("place", place).where(F.col("place") <= most).select(
        "*", (F.col("line_no") + 1).alias("viewer_line"), F.greatest(F.lit(0), F.col("line_no") - 20).alias("from_line"), (F.col("line_no") + 15).alias("to_line"), ask.alias("next_question")
    )


def domain_markers(lines: DataFrame) -> DataFrame:
    """Hits of every domain's markers by file, from one scan."""
    flags = F.array(*[F.when(F.col("text").rlike("(?i)" + p), F.struct(F.lit(d).alias("domain"), F.lit(k).alias("kind"))) for d, pack in PACKS.items() for k, p in pack.items()])
    return lines.select("file", F.explode(F.filter(flags, lambda x: x.isNotNull())).alias("m")).groupBy("file", "m.domain", "m.kind").agg(F.count(F.lit(1)).alias("hits"))


# --- saved investigations ---------------------------------------------------------------------

VERBS: dict[str, Callable[..., DataFrame]] = {
    "search": search.search, "filter": search.filter_basic, "scope_range": search.scope_range, "time_window": search.time_window, "time_gaps": sequence.time_gaps,
    "crashes": profile.crash_sites, "components": profile.component_errors, "levels": profile.level_counts, "templates": trend.recurring_templates, "mute": search.mute,
}


def register_verb(name: str, verb: Callable[..., DataFrame]) -> None:
    """Let saved investigations use another function from lines (and arguments) to a DataFrame."""
    VERBS[name] = verb


def replay(lines: DataFrame, steps: list[dict], overrides: dict[str, object] | None = None) -> DataFrame:
    """Run saved steps ``{"verb", "args", "params", "scope"}``: ``(step, verb, rows, ok, error)``.

    ``params`` maps an argument to a promoted parameter that ``overrides`` may set; a step with ``scope``
    true narrows the lines of the steps behind it, and its lines are stored once for all of them.  A
    step that cannot run, by an unknown verb, an argument that it lacks or does not know, or a pattern
    that is none, is not ok and tells why; it narrows nothing, and the others run.
    """
    rows = []
    for k, step in enumerate(steps):
        verb, args = step.get("verb"), dict(step.get("args", {}))
        args |= {a: (overrides or {})[p] for a, p in step.get("params", {}).items() if p in (overrides or {})}
        got, error = None, _cannot_run(verb, args)
        if error is None:
            try:
                got = VERBS[verb](lines, **args)
                row = got.agg(F.lit(k).alias("step"), F.lit(verb).alias("verb"), F.count(F.lit(1)).alias("rows"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
            except Exception as e:  # whatever a verb makes of its arguments
                got, error = None, f"{type(e).__name__}: {str(e).splitlines()[0]}"[:300] if str(e) else type(e).__name__
        if got is None:
            row = lines.sparkSession.createDataFrame([(k, str(verb), 0, False, error)], "step int, verb string, rows long, ok boolean, error string")
        elif step.get("scope"):
            if set(search.KEY) <= set(got.columns):
                lines = store(search.scope_of(lines, got), "scope")
            else:
                row = row.withColumn("ok", F.lit(False)).withColumn("error", F.lit("its rows are no lines, so they are no scope"))
        rows.append(row)
    out = rows[0] if rows else lines.sparkSession.createDataFrame([], "step int, verb string, rows long, ok boolean, error string")
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def _cannot_run(verb: object, args: dict) -> str | None:
    """Why a step cannot run, as far as its verb and arguments tell."""
    if verb not in VERBS:
        return f"unknown verb {verb!r}"
    try:
        inspect.signature(VERBS[verb]).bind(None, **args)
    except TypeError as e:
        return str(e)
    pattern = args.get("pattern")
    if isinstance(pattern, str) and args.get("regex"):
        wrong = search.pattern_error(pattern)
        return f"invalid pattern: {wrong}" if wrong else None
    return None


def check_requirements(lines: DataFrame, column_pattern: str | None = None, signature: str | None = None, name_glob: str | None = None, form: str | None = None, least: float = 0.6, head: int | None = None) -> DataFrame:
    """Whether files fit an investigation, a row for each: the share of lines that a column pattern
    reads, a signature in any line, the file's name, its format (of ``readers.detect_format``); of
    the first ``head`` lines if that is given.

    A check that is not asked for is null.  One that is not valid is null too and blocks nothing
    (``unverified`` counts these); any other that fails blocks the file.
    """
    head_of = lines if head is None else lines.where(F.col("line_no") < head)
    valid = {n: p is not None and search.pattern_error(p) is None for n, p in (("columns", column_pattern), ("signature", signature))}
    none = F.lit(None).cast("boolean")
    full = F.trim("text") != ""
    rate = F.avg(F.when(full, F.col("text").rlike(column_pattern).cast("double"))) if valid["columns"] else F.lit(None).cast("double")
    seen = F.bool_or(F.col("text").rlike(signature)) if valid["signature"] else none
    out = head_of.groupBy("file").agg(F.round(rate, 6).alias("match_rate"), seen.alias("signature"))
    glob = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in name_glob or "")
    out = out.withColumn("named", F.element_at(F.split("file", "/"), -1).rlike(f"(?i)^{glob}$") if name_glob else none)
    if form is not None:
        formats = readers.detect_format(lines).select("file", (F.col("format") == form).alias("format"))
        out = out.join(formats, "file", "left").withColumn("format", F.coalesce("format", F.lit(False)))
    else:
        out = out.withColumn("format", none)
    columns = F.coalesce("match_rate", F.lit(0.0)) >= least if valid["columns"] else none
    checks = [columns, F.col("signature"), F.col("named"), F.col("format")]
    blocked = F.lit(False)
    for c in checks:
        blocked = blocked | ~F.coalesce(c, F.lit(True))
    asked = [n for n, p in (("columns", column_pattern), ("signature", signature)) if p is not None and not valid[n]]
    return out.select("file", "match_rate", columns.alias("columns"), "signature", "named", "format", F.lit(len(asked)).alias("unverified"), blocked.alias("blocked"))


def usage_rollup(events: DataFrame) -> DataFrame:
    """Use of features by people and agents: ``(feature, actor, ts)`` to counts and last use."""
    return events.groupBy("feature").agg(F.count_if(F.col("actor") == "human").alias("human"), F.count_if(F.col("actor") == "ai").alias("ai"), F.count(F.lit(1)).alias("total"), F.max("ts").alias("last_used"))


def usage_days(events: DataFrame, days: int = 90) -> DataFrame:
    """Use by day over the last days that have any."""
    last = events.agg(F.max(F.to_date("ts")).alias("_d"))
    rows = events.withColumn("day", F.to_date("ts")).join(F.broadcast(last)).where(F.datediff("_d", "day") < days)
    return rows.groupBy("day").agg(F.count(F.lit(1)).alias("uses"))


def pattern_stats(events: DataFrame) -> DataFrame:
    """Applied patterns by source: ``(source, scanned, matched, ms, ok)``."""
    return events.groupBy("source").agg(F.count(F.lit(1)).alias("applied"), F.sum("scanned").alias("scanned"), F.sum("matched").alias("matched"), F.sum("ms").alias("ms"), F.count_if(~F.col("ok")).alias("invalid"))
