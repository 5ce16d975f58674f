"""Joins by nearness: clues around anchors, distances between patterns, merged timelines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts, parse
from ..sources.store import store
from . import alignment
from .ordered import CHUNK, Scan
from .quantiles import middles
from .sequence import carry_forward, timed

KEY = ["file", "line_no"]


def near_join(anchors: DataFrame, others: DataFrame, within: int, order: str = "line_no", by: tuple[str, ...] = ("file",)) -> DataFrame:
    """Pairs of rows whose order values lie at most ``within`` apart: an equality join on buckets
    of that width, the anchor's and its neighbours, then the exact condition.  ``others`` must
    have other column names than ``anchors`` but for ``by``; its order is ``other_<order>``."""
    width = max(1, within)
    bucket = F.floor(F.col(order) / width)
    a = anchors.withColumn("_b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    b = others.withColumn("_b", F.floor(F.col(f"other_{order}") / width))
    return a.join(b, [*by, "_b"]).where(F.abs(F.col(order) - F.col(f"other_{order}")) <= within).drop("_b")


def context_search(lines: DataFrame, must: dict[str, str], clues: dict[str, tuple[str, int | None]], default: int = 10, case: bool = True) -> DataFrame:
    """For each line that matches a must pattern: the clue lines near it (not on it), how many
    (the score; 1 without clue patterns), which clue patterns are missing, and whether none is.

    ``clues`` maps a name to pattern and distance; the default bounds a missing or larger one.
    """
    flag = "" if case else "(?i)"
    hit = lambda p: F.contains("text", F.lit(p)) if case else F.col("text").rlike(flag + re.escape(p))
    musts = F.filter(F.array(*[F.when(hit(p), n) for n, p in must.items()]), lambda x: x.isNotNull())
    anchors = lines.select(*KEY, F.explode(musts).alias("must_id"))
    if not clues:
        return anchors.select(*KEY, "must_id", F.lit(1).cast("long").alias("score"), F.lit("").alias("clue_lines"), F.lit("").alias("missing"), F.lit(True).alias("complete"))
    kinds = F.array(*[F.when(hit(p), F.struct(F.lit(n).alias("clue_id"), F.lit(min(d if d is not None else default, default)).alias("reach"))) for n, (p, d) in clues.items()])
    found = lines.select("file", F.col("line_no").alias("other_line_no"), F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("c")).select("file", "other_line_no", "c.clue_id", "c.reach")
    pairs = near_join(anchors, found, default)
    gap = F.abs(F.col("line_no") - F.col("other_line_no"))
    pairs = pairs.where((gap > 0) & (gap <= F.col("reach")))
    near = pairs.groupBy(*KEY, "must_id").agg(
        F.count(F.lit(1)).alias("_n"), F.array_join(F.array_sort(F.collect_set(F.format_string("%d:%s", "other_line_no", "clue_id"))), ",").alias("_lines"), F.collect_set("clue_id").alias("_ids")
    )
    names = F.array(*[F.lit(n) for n in sorted(clues)])
    missing = F.array_except(names, F.coalesce("_ids", F.array().cast("array<string>")))
    return anchors.join(near, [*KEY, "must_id"], "left").select(
        *KEY, "must_id", F.coalesce("_n", F.lit(0)).alias("score"), F.coalesce("_lines", F.lit("")).alias("clue_lines"), F.array_join(missing, ",").alias("missing"), (F.size(missing) == 0).alias("complete")
    )


#: Times of one file within so many milliseconds make a chunk of an ordered scan.
CHUNK_MS = 3_600_000


def context_search_time(lines: DataFrame, must: str, clue: str, window_ms: int, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Anchors with how many clues (not on their own line) stand at most ``window_ms`` apart in time, and the
    nearest one's distance; anchors without any are left out.

    No pairs are made: a count is the difference of two running counts of clues, and the nearest
    clue stands next to the anchor's time in order.  Both are asked once for each time, so a burst
    of lines of one time is one row.
    """
    known = timed(lines).select(*KEY, "ms", F.contains("text", F.lit(must)).alias("_must"), F.contains("text", F.lit(clue)).alias("_clue")).where("_must or _clue")
    known = store(known, "timed")
    anchors = known.where("_must").select(*KEY, "ms", F.col("_clue").cast("long").alias("_own"))
    clues = known.where("_clue").groupBy("file", "ms").agg(F.count(F.lit(1)).alias("_n"))
    asked = anchors.select("file", "ms").distinct()
    none = F.lit(0).cast("long")

    at = lambda rows, ms, kind, n: rows.select("file", F.col("ms").alias("_for"), ms.alias("_t"), F.lit(kind).alias("_kind"), n.alias("_n"))
    points = at(clues, F.col("ms"), 0, F.col("_n")).unionByName(at(asked, F.col("ms") - window_ms, -1, none)).unionByName(at(asked, F.col("ms") + window_ms, 1, none))
    counted = Scan(points, order="_t", chunk=chunk_ms, tie=("_kind", "_for")).running_sum("_n", "_upto").where("_kind <> 0")
    counts = counted.groupBy("file", F.col("_for").alias("ms")).agg(F.sum(F.col("_upto") * F.col("_kind")).alias("_within"))

    beside = Scan(clues.withColumn("_neg", -F.col("ms")), order="_neg", chunk=chunk_ms).lag("ms", "_next")
    beside = Scan(beside.drop("_neg"), order="ms", chunk=chunk_ms).lag("ms", "_prev").withColumn("_c", F.struct("ms", "_n", "_prev", "_next"))
    rows = beside.select("file", "ms", "_c", F.lit(0).alias("_kind")).unionByName(asked.select("file", "ms", F.lit(None).alias("_c"), F.lit(1).alias("_kind")))
    near = Scan(rows, order="ms", chunk=chunk_ms, tie=("_kind",)).both_known("_c", "_before", "_behind").where("_kind = 1").select("file", "ms", "_before", "_behind")

    out = anchors.join(counts, ["file", "ms"]).join(near, ["file", "ms"])
    alone = (F.col("_own") == 1) & (F.col("_before.ms") == F.col("ms")) & (F.col("_before._n") == 1)
    before = F.col("ms") - F.when(alone, F.col("_before._prev")).otherwise(F.col("_before.ms"))
    return out.where(F.col("_within") > F.col("_own")).select(*KEY, (F.col("_within") - F.col("_own")).alias("score"), F.least(before, F.col("_behind.ms") - F.col("ms")).alias("nearest_ms"))


def pattern_distance(a: DataFrame, b: DataFrame, mode: str = "nearest", chunk: int = CHUNK) -> DataFrame:
    """For each line of a its nearest, next (``after``) or last (``before``) line of b, and the
    distance.  A line of both is at 0; of two equally near ones the higher counts."""
    rows = a.select(*KEY, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(b.select(*KEY, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    rows = rows.groupBy(*KEY).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    rows = rows.withColumn("_line_b", F.when(F.col("_b") == 1, F.col("line_no")))
    both = Scan(rows, chunk=chunk).both_known("_line_b", "_low", "_high").where("_a = 1")
    nearer = F.col("line_no") - F.col("_low") < F.col("_high") - F.col("line_no")
    line = {"after": F.col("_high"), "before": F.col("_low"), "nearest": F.when(F.col("_high").isNull() | nearer, F.coalesce("_low", "_high")).otherwise(F.col("_high"))}[mode]
    return both.withColumn("b_line", line).where("b_line is not null").select("file", F.col("line_no").alias("a_line"), "b_line", F.abs(F.col("line_no") - F.col("b_line")).alias("distance"))


def gap_stats(pairs: DataFrame) -> DataFrame:
    d = F.col("distance")
    share = lambda t: F.round(F.avg((d <= t).cast("double")) * 100, 6)
    pairs = store(pairs.select("file", "distance"), "distances")
    sums = pairs.groupBy("file").agg(
        F.count(F.lit(1)).alias("pairs"), F.min(d).alias("min_gap"), F.max(d).alias("max_gap"), F.round(F.avg(d)).cast("long").alias("mean_gap"),
        share(5).alias("pct_5"), share(20).alias("pct_20"), share(100).alias("pct_100"),
    )
    middle = middles(pairs, ["file"], "distance").select("file", F.round((F.col("low") + F.col("high")) / 2).cast("long").alias("median_gap"))
    return sums.join(middle, "file").select("file", "pairs", "min_gap", "max_gap", "mean_gap", "median_gap", "pct_5", "pct_20", "pct_100")


def gap_histogram(pairs: DataFrame) -> DataFrame:
    d, out = F.col("distance"), F.lit("500+")
    for top, name in [(500, "101-500"), (100, "21-100"), (20, "6-20"), (5, "3-5"), (2, "1-2"), (0, "same line")]:
        out = F.when(d <= top, name).otherwise(out)
    return pairs.groupBy("file", out.alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))


def closest(pairs: DataFrame, k: int = 20) -> DataFrame:
    return pairs.orderBy("distance", "file", "a_line").limit(k)


def context_windows(hits: DataFrame, lines: DataFrame, n: int) -> DataFrame:
    """Each hit with the lines up to n before and behind it, in order."""
    near = hits.select("file", F.col("line_no").alias("hit_line"), F.explode(F.sequence(F.col("line_no") - n, F.col("line_no") + n)).alias("line_no"))
    rows = near.join(lines.select(*KEY, "text"), KEY)
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return rows.groupBy("file", "hit_line").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("context"), F.count(F.lit(1)).alias("lines"))


def origin_tags(files: DataFrame) -> DataFrame:
    """File name of each path, with its folder where two names collide."""
    parts = F.split("file", "/")
    base, parent = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    rows = files.select("file").distinct().withColumn("_base", base).withColumn("_long", F.concat_ws("/", parent, base))
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_base"))).select("file", F.when(F.col("_n") > 1, F.col("_long")).otherwise(F.col("_base")).alias("origin"))


def time_sync(lines: DataFrame) -> DataFrame:
    """All timed lines of all files; order by (ts, file, line_no) for one clock."""
    return timed(lines).select("ts", *KEY, "text")


def coverage(lines: DataFrame) -> DataFrame:
    """Timed share and span of each file."""
    return lines.withColumn("ts", facts.ts(lines)).groupBy("file").agg(F.count(F.lit(1)).alias("lines"), F.count("ts").alias("timed"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def merge_timeline(lines: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Every line with its own time or the last one before it; files without times are left out."""
    filled = carry_forward(lines.withColumn("_own", facts.ts(lines)), "_own", "ts", chunk).where("ts is not null")
    return filled.join(origin_tags(lines), "file").select("ts", "origin", *KEY, "text")


WEIGHTS = {"error": 25, "fatal": 25, "warning": 15, "info": 5}


def traceback(lines: DataFrame, targets: DataFrame, window_lines: int = 200, window_seconds: float = 60, most: int = 50, chunk: int = CHUNK) -> DataFrame:
    """For each target line the lines before it that likely led to it, by score.

    Same component 30; error 25, warning 15, info 5; a rise of the component's level 15; a
    crash word 20; nearness up to 10; shared words up to 10.  Scores above 5 stay, the best
    ``most`` for each target.
    """
    from .sequence import escalations

    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), F.lit(0)))
    rows = lines.select(
        *KEY, "text", facts.ts(lines).alias("ts"), facts.component(lines).alias("component"), facts.level(lines).alias("level"), parse.crash_keyword("text", "traceback").alias("crash")
    )
    up = escalations(lines, chunk).select(*KEY, F.lit(15).alias("_up"))
    # A target reads the lines before it only, so lines are looked up by number.
    t = rows.join(targets.select(*KEY).distinct(), KEY, "left_semi").select(
        "file", F.col("line_no").alias("target_line"), F.col("ts").alias("_tts"), F.col("component").alias("_tc"), words(F.col("text")).alias("_tw"),
        F.explode(F.sequence(F.greatest(F.lit(0), F.col("line_no") - window_lines), F.greatest(F.lit(0), F.col("line_no") - 1))).alias("line_no"),
    ).where("line_no < target_line")
    pairs = t.join(rows, KEY).join(up, KEY, "left")
    pairs = pairs.where(F.col("ts").isNull() | F.col("_tts").isNull() | ((parse.epoch_ms("_tts") - parse.epoch_ms("ts")) / 1000 <= window_seconds))
    level = F.coalesce(*[F.when(F.col("level") == n, w) for n, w in WEIGHTS.items()], F.lit(0))
    near = F.floor(10 * (1 - (F.col("target_line") - F.col("line_no")) / window_lines))
    shared = F.least(F.lit(10), 2 * F.size(F.array_intersect("_tw", words(F.col("text")))))
    score = F.when(F.col("component") == F.col("_tc"), 30).otherwise(0) + level + F.coalesce("_up", F.lit(0)) + F.when(F.col("crash").isNotNull(), 20).otherwise(0) + near + shared
    ranked = pairs.withColumn("score", score.cast("long")).where("score > 5")
    place = F.row_number().over(Window.partitionBy("file", "target_line").orderBy(F.desc("score"), F.desc("line_no")))
    category = F.when(F.col("crash").isNotNull(), "crash").when(F.col("_up").isNotNull(), "escalation").when(F.col("level").isin("error", "fatal"), "error").when(F.col("component") == F.col("_tc"), "component").otherwise("context")
    return ranked.withColumn("_r", place).where(F.col("_r") <= most).select("file", "target_line", "line_no", "score", category.alias("category"))


def resolve_marks(marks: DataFrame, lines: DataFrame) -> DataFrame:
    """Marks with text, level and time of their line."""
    rows = lines.select(*KEY, "text", facts.level(lines).alias("level"), facts.ts(lines).alias("ts"))
    return marks.join(rows, KEY, "left")


def evidence(findings: DataFrame, lines: DataFrame, k: int = 3) -> DataFrame:
    """The first k lines that show each finding ``(category, subject, …)``: lines of its level for a
    ``level-shift``, lines with its crash word for a ``new-crash``, else the error and warning lines
    of its component."""
    read = lines.select(*KEY, facts.component(lines).alias("_part"), facts.level(lines).alias("level"), facts.crash(lines).alias("_crash"))
    shown = F.array(
        F.struct(F.lit("level").alias("kind"), F.col("level").alias("subject")), F.struct(F.lit("crash").alias("kind"), F.col("_crash").alias("subject")),
        F.struct(F.lit("component").alias("kind"), F.when(F.col("level").isin("error", "fatal", "warning"), F.col("_part")).alias("subject")),
    )
    rows = read.select(*KEY, "level", F.explode(shown).alias("s")).select(*KEY, "level", "s.kind", "s.subject").where("subject is not null")
    # the first lines of each chunk, then of all chunks: no subject's lines are gathered in one task
    early = rows.groupBy("kind", "subject", "file", F.floor(F.col("line_no") / 10_000).alias("_c")).agg(F.slice(F.array_sort(F.collect_list(F.struct(*KEY, "level"))), 1, k).alias("e"))
    first = F.row_number().over(Window.partitionBy("kind", "subject").orderBy(*KEY))
    some = early.select("kind", "subject", F.explode("e").alias("e")).select("kind", "subject", "e.*").withColumn("_r", first).where(F.col("_r") <= k).drop("_r")
    kind = F.when(F.col("category") == "level-shift", "level").when(F.col("category") == "new-crash", "crash").otherwise("component")
    return findings.withColumn("kind", kind).join(some, ["kind", "subject"]).select(*findings.columns, *KEY, "level")


def line_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """How often each text stands in either of two logs, wherever; for an order-keeping
    comparison see :func:`diff_hunks`.

    The n-th occurrence of a text on one side pairs with the n-th on the other, so counts
    tell all: equal is the smaller one, the rest is removed or added.
    """
    both = left.select("text", F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(right.select("text", F.lit(0).alias("l"), F.lit(1).alias("r")))
    sums = both.groupBy("text").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return sums.select("text", F.least("l", "r").alias("equal"), F.greatest(F.lit(0), F.col("l") - F.col("r")).alias("removed"), F.greatest(F.lit(0), F.col("r") - F.col("l")).alias("added"))


def diff_hunks(left: DataFrame, right: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Runs of lines of one log against another, file by file and in order: ``(file, kind, start_line, lines,
    other_start)``, kind being equal, removed or modified for lines of the left log and added for lines of
    the right one.  Lines are told by their places in their files; see :func:`alignment.hunks`.
    """
    new = F.col("kind") == "added"
    pick = lambda a, b: F.when(new, F.col(a)).otherwise(F.col(b))
    found = alignment.hunks(left, right, chunk)
    return found.select("file", "kind", pick("right_start", "left_start").alias("start_line"), pick("right_lines", "left_lines").alias("lines"), pick("left_start", "right_start").alias("other_start"))


def align_clock(rows: DataFrame, low_ms: int, high_ms: int) -> DataFrame:
    """Device uptime to wall clock, by each file's first line with a plausible pair of both."""
    stamp = F.regexp_extract("text", r"(?:^|\s)timestamp=(\d+)", 1).try_cast("long")
    mono = F.regexp_extract("text", r"monotonicTimestamp=(\d+)", 1).try_cast("long")
    pairs = rows.select(*KEY, (stamp - mono).alias("_offset"), stamp.alias("_s")).where(F.col("_s").between(low_ms, high_ms) & F.col("_offset").isNotNull())
    anchor = pairs.groupBy("file").agg(F.min_by("_offset", "line_no").alias("_offset"))
    return rows.join(anchor, "file", "left").withColumn("wall_ms", F.col("uptime_ms") + F.col("_offset")).drop("_offset")
