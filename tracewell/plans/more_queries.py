"""Queries of proximity, profiles, sequences, trends, recipes and investigations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import alignment, extend, investigate, parts, profile, proximity, recipes, search, sequence, trend
from ..operators.ordered import CHUNK
from ..sources.views import D, L, document_lines, event_log, parsed_log, table
from .base import query


def keyed_orders(spark, sf):
    return table(spark, sf, "orders").select(F.lit("events").alias("file"), F.col("o_orderkey").alias("line_no"))


def halves(spark, sf):
    """The log as two files: even and odd components."""
    lines = event_log(spark, sf)
    odd = F.regexp_extract("text", r"\[svc-(\d)\]", 1).cast("int") % 2
    return lines.withColumn("file", F.concat(F.lit("host"), odd.cast("string"), F.lit("/app.log")))


H = L + ", H AS (SELECT * REPLACE ('host' || (user_id % 8 % 2) || '/app.log' AS file) FROM L) "

# --- proximity ----------------------------------------------------------------------------------


@query("j1_context_search", L + """, A AS (SELECT line_no FROM L WHERE contains(text, 'panic')), C AS (SELECT line_no AS c, 'signup' AS id, 10 AS reach FROM L WHERE event = 'signup' UNION ALL SELECT line_no, 'sevens', 3 FROM L WHERE contains(text, 'k=7')),
P AS (SELECT line_no, c, id FROM A JOIN C ON abs(line_no - c) BETWEEN 1 AND reach)
SELECT 'events' AS file, A.line_no, 'crash' AS must_id, count(c) AS score, coalesce(string_agg(c || ':' || id, ',' ORDER BY c || ':' || id), '') AS clue_lines,
  CASE WHEN count(*) FILTER (id = 'sevens') = 0 THEN CASE WHEN count(*) FILTER (id = 'signup') = 0 THEN 'sevens,signup' ELSE 'sevens' END WHEN count(*) FILTER (id = 'signup') = 0 THEN 'signup' ELSE '' END AS missing,
  count(DISTINCT id) = 2 AS complete FROM A LEFT JOIN P USING (line_no) GROUP BY A.line_no""")
def j1(spark, sf):
    return proximity.context_search(event_log(spark, sf), {"crash": "panic"}, {"signup": ("event=signup", None), "sevens": ("k=7", 3)})


@query("j2_context_search_time", L + "SELECT 'events' AS file, a.line_no, count(*) AS score, min(abs(a.ms - c.ms)) AS nearest_ms FROM L a JOIN L c ON c.event = 'signup' AND abs(a.ms - c.ms) <= 600000 AND a.line_no <> c.line_no WHERE a.crash = 'panic' GROUP BY a.line_no")
def j2(spark, sf):
    return proximity.context_search_time(event_log(spark, sf), "panic", "event=signup", 600_000)


PAIR = L + ", A AS (SELECT line_no AS a FROM L WHERE crash IS NOT NULL), B AS (SELECT line_no AS b FROM L WHERE event = 'purchase' AND k < 40) "
NEAR = PAIR + """, N AS (SELECT a, (SELECT max(b) FROM B WHERE b <= a) AS lo, (SELECT min(b) FROM B WHERE b >= a) AS hi FROM A),
P AS (SELECT 'events' AS file, a AS a_line, CASE WHEN hi IS NULL OR a - lo < hi - a THEN coalesce(lo, hi) ELSE hi END AS b_line FROM N), G AS (SELECT *, abs(a_line - b_line) AS distance FROM P) """


def sides(spark, sf):
    lines = event_log(spark, sf)
    return lines.where(F.col("text").rlike("panic|unhandled")), lines.where(F.contains("text", F.lit("event=purchase")) & (parse.field("text", "k").cast("int") < 40))


@query("j3_nearest", NEAR + "SELECT * FROM G")
def j3(spark, sf):
    return proximity.pattern_distance(*sides(spark, sf), chunk=CHUNK)


@query("j4_after", PAIR + "SELECT 'events' AS file, a AS a_line, min(b) AS b_line, min(b) - a AS distance FROM A JOIN B ON b >= a GROUP BY a")
def j4(spark, sf):
    return proximity.pattern_distance(*sides(spark, sf), mode="after", chunk=CHUNK)


@query("j5_before", PAIR + "SELECT 'events' AS file, a AS a_line, max(b) AS b_line, a - max(b) AS distance FROM A JOIN B ON b <= a GROUP BY a")
def j5(spark, sf):
    return proximity.pattern_distance(*sides(spark, sf), mode="before", chunk=CHUNK)


@query("j6_gap_stats", NEAR + """SELECT file, count(*) AS pairs, min(distance) AS min_gap, max(distance) AS max_gap, CAST(round(avg(distance)) AS BIGINT) AS mean_gap, CAST(round(median(distance)) AS BIGINT) AS median_gap,
round(avg(CASE WHEN distance <= 5 THEN 1.0 ELSE 0 END) * 100, 6) AS pct_5, round(avg(CASE WHEN distance <= 20 THEN 1.0 ELSE 0 END) * 100, 6) AS pct_20, round(avg(CASE WHEN distance <= 100 THEN 1.0 ELSE 0 END) * 100, 6) AS pct_100 FROM G GROUP BY file""")
def j6(spark, sf):
    return proximity.gap_stats(proximity.pattern_distance(*sides(spark, sf)))


@query("j7_gap_histogram", NEAR + "SELECT file, CASE WHEN distance = 0 THEN 'same line' WHEN distance <= 2 THEN '1-2' WHEN distance <= 5 THEN '3-5' WHEN distance <= 20 THEN '6-20' WHEN distance <= 100 THEN '21-100' WHEN distance <= 500 THEN '101-500' ELSE '500+' END AS bin, count(*) AS pairs FROM G GROUP BY ALL")
def j7(spark, sf):
    return proximity.gap_histogram(proximity.pattern_distance(*sides(spark, sf)))


@query("j7_closest", NEAR + "SELECT * FROM G ORDER BY distance, file, a_line LIMIT 20")
def j7_closest(spark, sf):
    return proximity.closest(proximity.pattern_distance(*sides(spark, sf)))


@query("j8_context_windows", L + "SELECT 'events' AS file, h.line_no AS hit_line, string_agg(l.text, chr(10) ORDER BY l.line_no) AS context, count(*) AS lines FROM L h JOIN L l ON l.line_no BETWEEN h.line_no - 3 AND h.line_no + 3 WHERE h.crash IS NOT NULL GROUP BY h.line_no")
def j8(spark, sf):
    lines = event_log(spark, sf)
    return proximity.context_windows(profile.crash_sites(lines), lines, 3)


@query("j9_time_sync", H + "SELECT ts, file, line_no, text FROM H")
def j9(spark, sf):
    return proximity.time_sync(halves(spark, sf))


@query("j9_coverage", H + "SELECT file, count(*) AS lines, count(*) AS timed, min(ts) AS first_ts, max(ts) AS last_ts FROM H GROUP BY file")
def j9_coverage(spark, sf):
    return proximity.coverage(halves(spark, sf))


@query("j10_merge_timeline", H + """, B AS (SELECT file, line_no, CASE WHEN line_no % 3 = 0 THEN ts END AS own FROM H), F AS (SELECT *, count(own) OVER (PARTITION BY file ORDER BY line_no) AS g FROM B)
SELECT coalesce(max(own) OVER (PARTITION BY file, g), first_value(own IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ts, file AS origin, file, line_no FROM F""")
def j10(spark, sf):
    lines = halves(spark, sf)
    bare = lines.withColumn("text", F.when(F.col("line_no") % 3 == 0, F.col("text")).otherwise(F.substring(F.col("text"), 24, 10_000)))
    return proximity.merge_timeline(bare, CHUNK).select("ts", "origin", "file", "line_no")


@query("j11_traceback", L + r""", U AS (SELECT *, list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}')) AS words, lag(level) OVER (PARTITION BY component ORDER BY line_no) AS before FROM L),
P AS (SELECT t.line_no AS target_line, u.line_no, u.crash, u.level, u.component = t.component AS same, (u.before = 'info' AND u.level IN ('warning', 'error')) OR (u.before = 'warning' AND u.level = 'error') IS TRUE AS up,
  floor(10 * (1 - (t.line_no - u.line_no) / 200.0)) AS near, least(10, 2 * len(list_intersect(t.words, u.words))) AS shared
  FROM U t JOIN U u ON u.line_no >= t.line_no - 200 AND u.line_no < t.line_no AND (t.ms - u.ms) / 1000.0 <= 60 WHERE t.crash IS NOT NULL),
S AS (SELECT *, CAST(CASE WHEN same THEN 30 ELSE 0 END + CASE level WHEN 'error' THEN 25 WHEN 'fatal' THEN 25 WHEN 'warning' THEN 15 WHEN 'info' THEN 5 ELSE 0 END + CASE WHEN up THEN 15 ELSE 0 END + CASE WHEN crash IS NOT NULL THEN 20 ELSE 0 END + near + shared AS BIGINT) AS score FROM P),
R AS (SELECT *, row_number() OVER (PARTITION BY target_line ORDER BY score DESC, line_no DESC) AS r FROM S WHERE score > 5)
SELECT 'events' AS file, target_line, line_no, score, CASE WHEN crash IS NOT NULL THEN 'crash' WHEN up THEN 'escalation' WHEN level IN ('error', 'fatal') THEN 'error' WHEN same THEN 'component' ELSE 'context' END AS category FROM R WHERE r <= 50""")
def j11(spark, sf):
    lines = parsed_log(spark, sf)
    return proximity.traceback(lines, profile.crash_sites(lines), chunk=CHUNK)


@query("j12_resolve_marks", L + "SELECT 'events' AS file, o_orderkey AS line_no, level, ts, text FROM orders LEFT JOIN L ON L.line_no = o_orderkey")
def j12(spark, sf):
    return proximity.resolve_marks(keyed_orders(spark, sf), event_log(spark, sf))


@query("j13_evidence", L + """, F AS (SELECT 'new-component' AS category, 'component' AS kind, component AS subject FROM L WHERE level IN ('error', 'fatal') GROUP BY component UNION ALL SELECT 'new-crash', 'crash', crash FROM L WHERE crash IS NOT NULL GROUP BY crash UNION ALL SELECT 'level-shift', 'level', 'warning'),
S AS (SELECT 'level' AS kind, level AS subject, line_no, level FROM L UNION ALL SELECT 'crash', crash, line_no, level FROM L WHERE crash IS NOT NULL UNION ALL SELECT 'component', component, line_no, level FROM L WHERE level IN ('error', 'fatal', 'warning')),
R AS (SELECT *, row_number() OVER (PARTITION BY kind, subject ORDER BY line_no) AS r FROM S) SELECT category, subject, 'events' AS file, line_no, R.level FROM F JOIN R USING (kind, subject) WHERE r <= 3""")
def j13(spark, sf):
    lines = parsed_log(spark, sf)
    parts = profile.component_errors(lines).where("errors > 0").select(F.lit("new-component").alias("category"), F.col("component").alias("subject"))
    words = profile.crashes_by_keyword(lines).select(F.lit("new-crash").alias("category"), F.col("keyword").alias("subject"))
    level = parts.limit(1).select(F.lit("level-shift").alias("category"), F.lit("warning").alias("subject"))
    return proximity.evidence(parts.unionByName(words).unionByName(level), lines)


@query("j14_line_diff", D + ", A AS (SELECT text, count(*) FILTER (length(file) % 2 = 0) AS l, count(*) FILTER (length(file) % 2 = 1) AS r FROM D GROUP BY text) SELECT text, least(l, r) AS equal, greatest(0, l - r) AS removed, greatest(0, r - l) AS added FROM A")
def j14(spark, sf):
    lines = document_lines(spark, sf)
    return proximity.line_diff(lines.where("length(file) % 2 = 0"), lines.where("length(file) % 2 = 1"))


@query("j14_diff_hunks", """WITH B AS (SELECT event_id // 5 AS block, event_id // 5 % 6 AS kind, count(*) AS n FROM events GROUP BY ALL),
S AS (SELECT block, kind, n, CAST(coalesce(sum(CASE WHEN kind = 1 THEN 0 ELSE n END) OVER w, 0) AS BIGINT) AS a, CAST(coalesce(sum(CASE WHEN kind = 3 THEN 0 ELSE n END) OVER w, 0) AS BIGINT) AS b FROM B WINDOW w AS (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT 'x' AS file, CASE kind WHEN 1 THEN 'added' WHEN 3 THEN 'removed' WHEN 5 THEN 'modified' ELSE 'equal' END AS kind, CASE kind WHEN 1 THEN b ELSE a END AS start_line, n AS lines, CASE kind WHEN 1 THEN a ELSE b END AS other_start FROM S""")
def j14_hunks(spark, sf):
    """Blocks of five lines in turn: equal, only right, equal, only left, equal, changed."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("id"), F.floor(F.col("event_id") / 5).alias("block"))
    kind = F.col("block") % 6
    text = F.concat(F.lit("e"), F.col("id"))

    def side(skipped: int, mark: str):
        rows = e.where(kind != skipped).select(F.lit("x").alias("file"), F.col("id").alias("line_no"), F.when(kind == 5, F.concat(text, F.lit(mark))).otherwise(text).alias("text"))
        return sequence.display_index(rows, CHUNK).select("file", F.col("display_index").alias("line_no"), "text")

    return proximity.diff_hunks(side(1, "l"), side(3, "r"), CHUNK)


@query("j14_hunks_of_files", """WITH N AS (SELECT 'host' || (user_id % 4) AS file, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS n, count(*) OVER (PARTITION BY user_id % 4) AS c FROM events),
I AS (SELECT file, 2 * n AS k, CASE WHEN n % 50 = 10 AND c > n + 3 OR n % 50 = 20 THEN 'removed' WHEN n % 50 = 30 THEN 'modified' ELSE 'equal' END AS kind, 1 AS l, CASE WHEN n % 50 = 10 AND c > n + 3 OR n % 50 = 20 THEN 0 ELSE 1 END AS r FROM N
  UNION ALL SELECT file, 2 * n + 7, 'added', 0, 1 FROM N WHERE n % 50 = 10 AND c > n + 3 UNION ALL SELECT file, 2 * n + 1, 'added', 0, 1 FROM N WHERE n % 50 = 40),
S AS (SELECT *, coalesce(kind <> lag(kind) OVER w, true) AS fresh, sum(l) OVER w - l AS a, sum(r) OVER w - r AS b FROM I WINDOW w AS (PARTITION BY file ORDER BY k ROWS UNBOUNDED PRECEDING)),
R AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY file ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM S)
SELECT file, any_value(kind) AS kind, CAST(min(a) AS BIGINT) AS left_start, CAST(sum(l) AS BIGINT) AS left_lines, CAST(min(b) AS BIGINT) AS right_start, CAST(sum(r) AS BIGINT) AS right_lines FROM R GROUP BY file, run""")
def j14_files(spark, sf):
    """The log of four hosts against one where of fifty lines one moved three places on, one is gone, one differs and one is new."""
    e = table(spark, sf, "events").select(F.concat(F.lit("host"), F.col("user_id") % 4).alias("file"), F.col("event_id").alias("line_no"), F.concat(F.lit("e"), F.col("event_id")).alias("text"))
    left = sequence.display_index(e, CHUNK).select("file", F.col("display_index").alias("line_no"), "text")
    place, moved = F.col("line_no") % 50, (F.col("line_no") % 50 == 10) & (F.col("c") > F.col("line_no") + 3)
    known = left.join(left.groupBy("file").agg(F.count(F.lit(1)).alias("c")), "file").where(place != 20)
    there = F.struct((2 * F.col("line_no") + F.when(moved, 7).otherwise(0)).alias("line_no"), F.when(place == 30, F.concat("text", F.lit("~"))).otherwise(F.col("text")).alias("text"))
    new = F.when(place == 40, F.struct((2 * F.col("line_no") + 1).alias("line_no"), F.concat(F.lit("new"), "text").alias("text")))
    right = known.select("file", F.explode(F.filter(F.array(there, new), lambda x: x.isNotNull())).alias("x")).select("file", "x.*")
    return alignment.hunks(left, right, CHUNK)


@query("j15_align_clock", "SELECT 'dev' || (event_id % 4) AS file, event_id AS line_no, user_id * 100 + event_id + min_by(epoch_ms(date_trunc('milliseconds', ts)) - event_id * 7, event_id) OVER (PARTITION BY event_id % 4) AS wall_ms FROM events")
def j15(spark, sf):
    e = table(spark, sf, "events")
    rows = e.select(F.concat(F.lit("dev"), F.col("event_id") % 4).alias("file"), F.col("event_id").alias("line_no"), (F.col("user_id") * 100 + F.col("event_id")).alias("uptime_ms"),
                    F.concat(F.lit("x timestamp="), F.unix_millis(F.col("ts").cast("timestamp")), F.lit(" monotonicTimestamp="), F.col("event_id") * 7).alias("text"))
    return proximity.align_clock(rows, 1_000_000_000_000, 3_000_000_000_000).select("file", "line_no", "wall_ms")


@query("j16_out_of_scope", L + "SELECT file, line_no FROM L WHERE event <> 'click'")
def j16(spark, sf):
    lines = event_log(spark, sf)
    return search.out_of_scope(lines, search.search(lines, "event=click")).select("file", "line_no")


# --- profiles -----------------------------------------------------------------------------------

LEVEL_LIST = "(VALUES ('fatal'), ('error'), ('warning'), ('info'), ('debug'), ('verbose'), ('trace')) AS v(level)"


@query("a1_level_counts", L + f"SELECT 'events' AS file, v.level, count(L.level) AS lines, round(count(L.level) * 100.0 / (SELECT count(*) FROM L), 2) AS percent FROM {LEVEL_LIST} LEFT JOIN L USING (level) GROUP BY v.level")
def a1(spark, sf):
    return profile.level_counts(event_log(spark, sf))


@query("a2_crash_sites", L + "SELECT file, line_no, crash AS keyword, level, component, text FROM L WHERE crash IS NOT NULL")
def a2(spark, sf):
    return profile.crash_sites(event_log(spark, sf))


@query("a3_crashes_by_keyword", L + "SELECT file, crash AS keyword, count(*) AS crashes, min(line_no) AS first_line, min_by(text, line_no) AS sample FROM L WHERE crash IS NOT NULL GROUP BY ALL")
def a3(spark, sf):
    return profile.crashes_by_keyword(event_log(spark, sf))


ERRORS = L + ", E AS (SELECT file, component, count(*) FILTER (level IN ('error', 'fatal')) AS errors, count(*) FILTER (level = 'warning') AS warnings, min(line_no) FILTER (level IN ('error', 'fatal')) AS first_error, count(*) AS lines FROM L GROUP BY file, component) "


@query("a4_component_errors", ERRORS + "SELECT * FROM E")
def a4(spark, sf):
    return profile.component_errors(event_log(spark, sf))


@query("a4_top_failing", ERRORS + "SELECT file, component, errors, warnings, first_error FROM E WHERE errors > 0 ORDER BY errors DESC, component LIMIT 5")
def a4_top(spark, sf):
    return profile.top_failing(event_log(spark, sf))


@query("a4_component_rollup", L + "SELECT file, component, level, count(*) AS lines, CAST(grouping_id(file, component, level) AS BIGINT) AS grouping FROM L GROUP BY ROLLUP (file, component, level)")
def a4_rollup(spark, sf):
    return profile.component_rollup(event_log(spark, sf))


@query("a5_time_span", L + "SELECT file, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS last_ts FROM L GROUP BY file")
def a5(spark, sf):
    return profile.time_span(event_log(spark, sf))


@query("a6_level_density", L + "SELECT file, CAST(line_no * 50 // (SELECT max(line_no) + 1 FROM L) AS BIGINT) AS bucket, level, count(*) AS lines FROM L GROUP BY ALL")
def a6(spark, sf):
    return profile.level_density(event_log(spark, sf), 50)


@query("a7_severity_ticks", L + "SELECT file, CAST(line_no * 64 // (SELECT max(line_no) + 1 FROM L) AS BIGINT) AS bucket, max(CASE level WHEN 'fatal' THEN 3 WHEN 'error' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) AS rank FROM L GROUP BY ALL")
def a7(spark, sf):
    return profile.severity_ticks(event_log(spark, sf), 64)


@query("a8_severity_counts", L + "SELECT file, count(*) FILTER (level = 'fatal') AS fatal, count(*) FILTER (level = 'error') AS error, count(*) FILTER (level = 'warning') AS warning FROM L GROUP BY file")
def a8(spark, sf):
    return profile.severity_counts(event_log(spark, sf))


@query("a9_filter_suggestions", ERRORS + """, S AS (SELECT count(*) AS n, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w, count(*) FILTER (level IN ('debug', 'trace')) AS d FROM L)
SELECT 'events' AS file, 'filter-errors-only' AS id, e AS lines FROM S WHERE e > 0 AND e < n * 0.5 UNION ALL SELECT 'events', 'filter-errors-warnings', e + w FROM S WHERE e + w > 0 AND e + w < n * 0.5
UNION ALL SELECT 'events', 'filter-no-debug', d FROM S WHERE d > n * 0.3 UNION ALL (SELECT file, 'filter-component-' || component, errors FROM E WHERE errors > 5 ORDER BY errors DESC, component LIMIT 3)""")
def a9(spark, sf):
    return profile.filter_suggestions(event_log(spark, sf))


@query("a10_scoped_analysis", L + f"SELECT 'events' AS file, v.level, count(S.level) AS lines, round(count(S.level) * 100.0 / (SELECT count(*) FROM L WHERE line_no BETWEEN 200 AND 900), 2) AS percent FROM {LEVEL_LIST} LEFT JOIN (SELECT * FROM L WHERE line_no BETWEEN 200 AND 900) S USING (level) GROUP BY v.level")
def a10(spark, sf):
    return profile.level_counts(search.scope_range(event_log(spark, sf), 200, 900))


@query("a10_analyze", ERRORS + """, S AS (SELECT count(*) AS n, count(*) FILTER (level = 'error') AS e, count(*) FILTER (level = 'warning') AS w, count(*) FILTER (level IN ('debug', 'trace')) AS d FROM L),
T AS (SELECT *, row_number() OVER (ORDER BY errors DESC, component) AS r FROM E WHERE errors > 0)
SELECT 'events' AS file, 'level' AS section, 1 AS place, level AS item, count(*) AS n, min(line_no) AS line_no FROM L GROUP BY level UNION ALL SELECT 'events', 'crash', 1, crash, count(*), min(line_no) FROM L WHERE crash IS NOT NULL GROUP BY crash
UNION ALL SELECT 'events', 'failing', r, component, errors, first_error FROM T WHERE r <= 5
UNION ALL SELECT 'events', 'first time', 1, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g'), NULL, NULL FROM L UNION ALL SELECT 'events', 'last time', 1, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g'), NULL, NULL FROM L
UNION ALL SELECT 'events', 'filter', 1, 'filter-errors-only', e, NULL FROM S WHERE e > 0 AND e < n * 0.5 UNION ALL SELECT 'events', 'filter', 1, 'filter-errors-warnings', e + w, NULL FROM S WHERE e + w > 0 AND e + w < n * 0.5
UNION ALL SELECT 'events', 'filter', 1, 'filter-no-debug', d, NULL FROM S WHERE d > n * 0.3 UNION ALL (SELECT file, 'filter', 1, 'filter-component-' || component, errors, NULL FROM E WHERE errors > 5 ORDER BY errors DESC, component LIMIT 3)""")
def a10_analyze(spark, sf):
    return investigate.analyze(parsed_log(spark, sf))


@query("a10_analyze_columns", """WITH R AS (SELECT o_orderkey + 1 AS line_no, CASE o_orderkey % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'info' ELSE 'warning' END AS level, 'c' || (o_custkey % 9) AS component, CASE WHEN o_orderkey % 5 = 0 THEN 'panic' END AS crash FROM orders),
E AS (SELECT component, count(*) FILTER (level = 'error') AS errors, min(line_no) FILTER (level = 'error') AS f FROM R GROUP BY component), T AS (SELECT *, row_number() OVER (ORDER BY errors DESC, component) AS r FROM E WHERE errors > 0)
SELECT 'level' AS section, 1 AS place, level AS item, count(*) AS n, min(line_no) AS line_no FROM R GROUP BY level UNION ALL SELECT 'crash', 1, crash, count(*), min(line_no) FROM R WHERE crash IS NOT NULL GROUP BY crash UNION ALL SELECT 'failing', r, component, errors, f FROM T WHERE r <= 5""")
def a10_columns(spark, sf):
    """A delimited log with a header, whose level and message cells say other things than the line."""
    from ..operators import columns

    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    level = F.when(k % 3 == 0, "Severe").when(k % 3 == 1, "information").otherwise("notice")
    text = F.concat_ws("|", F.lit("fatal-looking source"), level, F.concat(F.lit("c"), F.col("o_custkey") % 9, F.lit(".inner")), F.when(k % 5 == 0, "kernel PANIC").otherwise("fine"))
    head = o.limit(1).select(F.lit("o.psv").alias("file"), F.lit(0).cast("long").alias("line_no"), F.lit("origin|level|component|message").alias("text"))
    lines = o.select(F.lit("o.psv").alias("file"), (k + 1).alias("line_no"), text.alias("text")).unionByName(head)
    return investigate.analyze(columns.by_role(lines)).where("section in ('level', 'crash', 'failing')").drop("file")


@query("a11_merge_analysis", H + ", E AS (SELECT component, count(*) FILTER (level IN ('error', 'fatal')) AS errors, count(*) FILTER (level = 'warning') AS warnings, min(file) AS file, min(line_no) FILTER (level IN ('error', 'fatal')) AS first_error FROM H GROUP BY component) SELECT component, errors, warnings, file, first_error FROM E WHERE errors > 0 ORDER BY errors DESC, component LIMIT 5")
def a11(spark, sf):
    return profile.merge_analysis(halves(spark, sf))


@query("a11_merged_parts", H + ", E AS (SELECT component, count(*) FILTER (level IN ('error', 'fatal')) AS errors, count(*) FILTER (level = 'warning') AS warnings, min(file) AS file, min(line_no) FILTER (level IN ('error', 'fatal')) AS first_error FROM H GROUP BY component) SELECT component, errors, warnings, file, first_error FROM E WHERE errors > 0 ORDER BY errors DESC, component LIMIT 5")
def a11_parts(spark, sf):
    """The same from the parts of three stretches of the log."""
    lines = halves(spark, sf)
    stretches = [parts.profile_parts(lines.where(F.col("line_no") % 3 == k)) for k in range(3)]
    return parts.worst_components(stretches[0].unionByName(stretches[1]).unionByName(stretches[2]))


@query("a12_minute_density", L + ", T AS (SELECT min(date_trunc('second', ts)) AS t0 FROM L), M AS (SELECT CAST(floor((epoch_ms(date_trunc('second', ts)) - epoch_ms(t0)) / 60000) AS BIGINT) AS minute, count(*) AS n FROM L, T GROUP BY 1) SELECT 'events' AS file, CAST(g AS BIGINT) AS minute, coalesce(n, 0) AS lines FROM (SELECT unnest(range(0, (SELECT max(minute) + 1 FROM M))) AS g) LEFT JOIN M ON g = minute")
def a12(spark, sf):
    return profile.minute_density(event_log(spark, sf))


@query("a13_component_counts", L + "SELECT file, component, count(*) AS lines FROM L GROUP BY ALL")
def a13(spark, sf):
    return profile.component_counts(event_log(spark, sf))


@query("a14_level_samples", L + "SELECT file, level, CAST(least(9, line_no * 10 // (SELECT max(line_no) + 1 FROM L)) AS BIGINT) AS stripe, min(line_no) AS line_no FROM L GROUP BY ALL")
def a14(spark, sf):
    return profile.level_samples(event_log(spark, sf))


@query("a15_component_samples", L + ", R AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY line_no) AS r FROM L WHERE level IN ('error', 'warning')) SELECT file, component, line_no, level FROM R WHERE r <= 5")
def a15(spark, sf):
    return profile.component_samples(event_log(spark, sf))


@query("a16_fingerprint", H + f""", C AS (SELECT u.file, v.level, count(x.level) AS n FROM (SELECT DISTINCT file FROM H) u CROSS JOIN {LEVEL_LIST} LEFT JOIN H x ON x.file = u.file AND x.level = v.level GROUP BY ALL),
M AS (SELECT file, CAST(floor((epoch_ms(date_trunc('second', ts)) - min(epoch_ms(date_trunc('second', ts))) OVER (PARTITION BY file)) / 60000) AS BIGINT) AS m FROM H),
B AS (SELECT file, component, count(*) FILTER (level IN ('error', 'fatal')) AS e, count(*) AS n FROM H GROUP BY ALL), G AS (SELECT file, component, level, crash, min(line_no) AS f FROM H WHERE level IN ('error', 'fatal') OR crash IS NOT NULL GROUP BY ALL), R AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY f) AS r FROM G)
SELECT file, count(*) AS total_lines, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g') AS last_ts,
  (SELECT string_agg(level || '=' || n, ',' ORDER BY level) FROM C WHERE C.file = H.file) AS levels, (SELECT string_agg(component || '=' || n, ',' ORDER BY component) FROM B WHERE B.file = H.file) AS components,
  (SELECT string_agg(component || '=' || e, ',' ORDER BY component) FROM B WHERE B.file = H.file AND e > 0) AS failing, string_agg(DISTINCT crash, ',' ORDER BY crash) AS crashes,
  (SELECT max(m) + 1 FROM M WHERE M.file = H.file) AS minutes, (SELECT max(k) FROM (SELECT count(*) AS k FROM M WHERE M.file = H.file GROUP BY m)) AS most_in_a_minute, (SELECT string_agg(f, ',' ORDER BY f) FROM R WHERE R.file = H.file AND r <= 5) AS samples FROM H GROUP BY file""")
def a16(spark, sf):
    pairs = lambda c: F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias(c)
    return profile.fingerprint(halves(spark, sf)).select(
        "file", "total_lines", "first_ts", "last_ts", pairs("levels"), pairs("components"), pairs("failing"), F.array_join("crashes", ",").alias("crashes"),
        "minutes", F.array_max(F.transform("density", lambda x: x["lines"])).alias("most_in_a_minute"), F.array_join(F.transform("samples", lambda x: x.cast("string")), ",").alias("samples"),
    )


def two_runs(spark, sf):
    """The log's halves by position: the first is the base, the second the current run."""
    lines = event_log(spark, sf)
    middle = F.broadcast(lines.agg(F.max("line_no").alias("_m")))
    both = lines.join(middle).withColumn("_late", F.col("line_no") * 2 > F.col("_m"))
    late = both.where("_late").withColumn("text", F.regexp_replace("text", r"\[svc-3\]", "[svc-new]"))
    return late.drop("_m", "_late"), both.where("not _late").drop("_m", "_late")


def compared(late: str, renamed: str = "false") -> str:
    """The findings between the lines that are ``late`` and the others, as FOUND; components of
    ``renamed`` lines are called svc-new."""
    return L + f""", R AS (SELECT * REPLACE (CASE WHEN {renamed} THEN 'svc-new' ELSE component END AS component), {late} AS cur FROM L),
V AS (SELECT level, coalesce(count(*) FILTER (cur) * 100.0 / (SELECT count(*) FROM R WHERE cur), 0) AS c, coalesce(count(*) FILTER (NOT cur) * 100.0 / (SELECT count(*) FROM R WHERE NOT cur), 0) AS b FROM R GROUP BY level),
E AS (SELECT component, cur, count(*) FILTER (level IN ('error', 'fatal')) AS e, count(*) AS n FROM R GROUP BY ALL), EC AS (SELECT * FROM E WHERE cur), EB AS (SELECT * FROM E WHERE NOT cur),
M0 AS (SELECT cur, date_trunc('second', ts) AS t, min(date_trunc('second', ts)) OVER (PARTITION BY cur) AS t0 FROM R), M1 AS (SELECT cur, CAST(floor((epoch_ms(t) - epoch_ms(t0)) / 60000) AS BIGINT) AS m FROM M0), M2 AS (SELECT cur, m, count(*) AS k FROM M1 GROUP BY ALL),
VP AS (SELECT cur, (sum(k * k) / (max(m) + 1.0)) - (sum(k) / (max(m) + 1.0)) * (sum(k) / (max(m) + 1.0)) AS v FROM M2 GROUP BY cur),
FOUND AS (SELECT CASE WHEN abs(c - b) > 15 THEN 'critical' ELSE 'warning' END AS severity, 'level-shift' AS category, level AS subject FROM V WHERE abs(c - b) > 5
UNION ALL SELECT 'critical', 'new-crash', crash FROM (SELECT DISTINCT crash FROM R WHERE cur AND crash IS NOT NULL EXCEPT SELECT crash FROM R WHERE NOT cur)
UNION ALL SELECT 'warning', 'new-component', component FROM EC WHERE e > 0 AND component NOT IN (SELECT component FROM EB WHERE e > 0)
UNION ALL SELECT 'info', 'missing-component', component FROM EB WHERE n > 10 AND component NOT IN (SELECT component FROM EC)
UNION ALL SELECT CASE WHEN EC.e / EB.e > 5 THEN 'critical' ELSE 'warning' END, 'error-rate', EC.component FROM EC JOIN EB USING (component) WHERE EB.e > 0 AND EC.e / EB.e > 2
UNION ALL SELECT 'info', 'density', 'variance' FROM (SELECT max(v) / min(v) AS r FROM VP) WHERE r > 3)
"""


LATE = "line_no * 2 > (SELECT max(line_no) FROM L)"
COMPARED = compared(LATE, f"{LATE} AND component = 'svc-3'")


@query("a17_compare_profiles", COMPARED + "SELECT * FROM FOUND")
def a17(spark, sf):
    return profile.compare_profiles(*two_runs(spark, sf))


@query("a18_verdict", COMPARED + "SELECT CASE WHEN c > 2 THEN 'significantly-degraded' WHEN c > 0 OR w > 0 THEN 'degraded' WHEN n > 0 THEN 'improved' ELSE 'stable' END AS verdict, c AS critical, w AS warnings FROM (SELECT count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS w, count(*) AS n FROM FOUND)")
def a18(spark, sf):
    return profile.verdict(profile.compare_profiles(*two_runs(spark, sf)))


@query("a19_compare_windows", compared("line_no > (SELECT max(line_no) FROM L) // 3") + "SELECT * FROM FOUND")
def a19(spark, sf):
    lines = parsed_log(spark, sf)
    last = lines.agg(F.max("line_no")).first()[0] or 0
    return extend.compare_windows(lines, (last // 3 + 1, last), (0, last // 3))


@query("a20_discover_fields", L + """, F AS (SELECT unnest([{'n': 'event', 'r': event}, {'n': 'user_id', 'r': CAST(user_id AS VARCHAR)}, {'n': 'value', 'r': printf('%.2f', value)}, {'n': 'k', 'r': CAST(k AS VARCHAR)}]) AS f FROM L UNION ALL SELECT {'n': 'panic', 'r': 'out'} FROM L WHERE crash = 'panic'),
R AS (SELECT f.n AS name, f.r AS raw FROM F), V AS (SELECT name, raw, row_number() OVER (PARTITION BY name ORDER BY raw) AS r FROM (SELECT DISTINCT name, raw FROM R))
SELECT name, CASE WHEN name IN ('event', 'panic') THEN 'string' ELSE 'numeric' END AS type, count(*) AS occurrences, count(DISTINCT raw) AS distinct, (SELECT string_agg(raw, '|' ORDER BY raw) FROM V WHERE V.name = R.name AND r <= 3) AS examples FROM R GROUP BY name""".replace("AS distinct,", 'AS "distinct",'))
def a20(spark, sf):
    return trend.discover_fields(event_log(spark, sf))


@query("a21_discover_axes", L + """, X AS (SELECT line_no, unnest([{'a': 'line', 'x': CAST(line_no AS DOUBLE)}, {'a': 'time', 'x': CAST(ms AS DOUBLE)}, {'a': 'field:value', 'x': value}, {'a': 'field:user_id', 'x': CAST(user_id AS DOUBLE)}, {'a': 'field:k', 'x': CAST(k AS DOUBLE)}]) AS v FROM L),
Y AS (SELECT v.a AS axis, v.x AS x, lag(v.x) OVER (PARTITION BY v.a ORDER BY line_no) AS p FROM X), Z AS (SELECT axis, count(*) AS points, min(x) AS x_min, max(x) AS x_max, round(avg(CASE WHEN x >= p THEN 1.0 WHEN x < p THEN 0.0 END), 6) AS monotone FROM Y GROUP BY axis)
SELECT 'events' AS file, *, 1.0 AS coverage, round(CASE axis WHEN 'line' THEN 0.15 WHEN 'time' THEN 0.9 + 0.1 * monotone ELSE least(monotone * monotone, 0.12) END, 6) AS score FROM Z""")
def a21(spark, sf):
    return trend.discover_axes(parsed_log(spark, sf))


CLOCKS = "WITH E AS (SELECT event_id AS line_no, CAST(floor(epoch(ts)) AS BIGINT) AS uptime, CAST(round(value) AS BIGINT) AS latency FROM events) "


@query("a21_named_axes", CLOCKS + """, Y AS (SELECT uptime AS x, lag(uptime) OVER (ORDER BY line_no) AS p FROM E), Z AS (SELECT count(*) AS points, CAST(min(x) AS DOUBLE) AS x_min, CAST(max(x) AS DOUBLE) AS x_max, round(avg(CASE WHEN x >= p THEN 1.0 WHEN x < p THEN 0.0 END), 6) AS monotone FROM Y)
SELECT 'e' AS file, 'field:uptime' AS axis, *, 1.0 AS coverage, round(monotone * monotone, 6) AS score FROM Z UNION ALL SELECT 'e', 'line', count(*), CAST(min(line_no) AS DOUBLE), CAST(max(line_no) AS DOUBLE), 1.0, 1.0, 0.15 FROM E""")
def a21_named(spark, sf):
    """A clock's name scores above the line number; a duration that does not rise is no axis."""
    e = table(spark, sf, "events")
    text = F.format_string("uptime: %d latency: %d", F.unix_seconds(F.col("ts").cast("timestamp")), F.round("value").cast("long"))
    return trend.discover_axes(e.select(F.lit("e").alias("file"), F.col("event_id").alias("line_no"), text.alias("text")))


BUCKET = L + ", B AS (SELECT *, CAST(least(199, floor((CAST(ms AS DOUBLE) - (SELECT min(ms) FROM L)) * 200 / (SELECT max(ms) - min(ms) FROM L))) AS BIGINT) AS bucket FROM L) "


@query("a22_series", BUCKET + "SELECT file, bucket, count(*) AS points, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high, round(sum(value) / count(*), 6) AS average FROM B GROUP BY ALL")
def a22(spark, sf):
    return trend.series(event_log(spark, sf), "value")


@query("a23_series_top_values", BUCKET + ", C AS (SELECT file, bucket, event AS value, count(*) AS n FROM B GROUP BY ALL), R AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, value) AS rank FROM C) SELECT * FROM R WHERE rank <= 3")
def a23(spark, sf):
    return trend.series_top_values(event_log(spark, sf), "event", k=3)


@query("a22_series_pattern", BUCKET + "SELECT file, bucket, count(*) AS points, round(sum(CAST(k AS DOUBLE)), 6) AS total, CAST(min(k) AS DOUBLE) AS low, CAST(max(k) AS DOUBLE) AS high, round(sum(k) / count(*), 6) AS average FROM B GROUP BY ALL")
def a22_pattern(spark, sf):
    return trend.series(parsed_log(spark, sf), None, pattern=r" k=(\d+)")


@query("a24_signals", L + """, B AS (SELECT line_no, ms, CAST(floor(line_no / ceil((SELECT max(line_no) + 1 FROM L) / 100.0)) AS BIGINT) AS bucket, unnest([{'f': 'value', 'v': value}, {'f': 'k', 'v': CAST(k AS DOUBLE)}]) AS e FROM L),
G AS (SELECT e.f AS field, bucket, count(*) AS points, avg(e.v) AS a, min(e.v) AS low, max(e.v) AS high, min(line_no) AS first_line, min_by(ms, line_no) AS first_ms FROM B GROUP BY ALL)
SELECT 'events' AS file, field, bucket, points, round(a, 6) AS average, low, high, first_line, first_ms, round((a - min(low) OVER w) / (max(high) OVER w - min(low) OVER w), 6) AS scaled FROM G WINDOW w AS (PARTITION BY field)""")
def a24(spark, sf):
    return trend.signals(parsed_log(spark, sf), ["value", "k"])


def json_log(spark, sf):
    """The event log as JSON objects."""
    e = table(spark, sf, "events")
    row = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("time"), F.col("event_type").alias("event"), F.col("user_id"), F.format_string("%.2f", "value").cast("double").alias("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("user_id") % 2 == 0).alias("even"),
    ))
    return e.select(F.lit("events").alias("file"), F.col("event_id").alias("line_no"), row.alias("text"))


def colon_log(spark, sf):
    """The event log as ``k: v`` and ``k = v`` pairs."""
    e = table(spark, sf, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSS"), F.lit(" event: "), F.col("event_type"), F.format_string(" value = %.2f", "value"), F.lit(", k: "), F.get_json_object("props", "$.k"))
    return e.select(F.lit("events").alias("file"), F.col("event_id").alias("line_no"), text.alias("text"))


SERIES = "SELECT file, bucket, count(*) AS points, round(sum(value), 6) AS total, min(value) AS low, max(value) AS high, round(sum(value) / count(*), 6) AS average FROM B GROUP BY ALL"


@query("a22_series_json", BUCKET + SERIES)
def a22_json(spark, sf):
    return trend.series(json_log(spark, sf), "value")


@query("a22_series_colon", BUCKET + SERIES)
def a22_colon(spark, sf):
    return trend.series(colon_log(spark, sf), "value")


@query("a23_top_values_json", BUCKET + ", C AS (SELECT file, bucket, CAST(user_id % 2 = 0 AS VARCHAR) AS value, count(*) AS n FROM B GROUP BY ALL), R AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY n DESC, value) AS rank FROM C) SELECT * FROM R WHERE rank <= 8")
def a23_json(spark, sf):
    return trend.series_top_values(json_log(spark, sf), "even")


@query("a24_signals_colon", L + """, B AS (SELECT line_no, ms, CAST(floor(line_no / ceil((SELECT max(line_no) + 1 FROM L) / 100.0)) AS BIGINT) AS bucket, unnest([{'f': 'value', 'v': value}, {'f': 'k', 'v': CAST(k AS DOUBLE)}]) AS e FROM L),
G AS (SELECT e.f AS field, bucket, count(*) AS points, avg(e.v) AS a, min(e.v) AS low, max(e.v) AS high, min(line_no) AS first_line, min_by(ms, line_no) AS first_ms FROM B GROUP BY ALL)
SELECT 'events' AS file, field, bucket, points, round(a, 6) AS average, low, high, first_line, first_ms, round((a - min(low) OVER w) / (max(high) OVER w - min(low) OVER w), 6) AS scaled FROM G WINDOW w AS (PARTITION BY field)""")
def a24_colon(spark, sf):
    return trend.signals(colon_log(spark, sf), ["value", "k"])


@query("a25_correlate_json", L + "SELECT file, event = 'error' AS with_event, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM L GROUP BY ALL")
def a25_json(spark, sf):
    return trend.correlate(json_log(spark, sf), "value", '"event":"ERROR"')


@query("w7_transitions_json", L + ", R AS (SELECT file, line_no, lag(event) OVER (ORDER BY line_no) AS from_value, event AS to_value FROM L) SELECT * FROM R WHERE from_value <> to_value")
def w7_json(spark, sf):
    return sequence.transitions(json_log(spark, sf), parse.field("text", "event"), CHUNK)


@query("r7_flips_colon", L + ", R AS (SELECT line_no, lag(event) OVER (ORDER BY line_no) AS a, event AS b FROM L) SELECT 'events' AS file, line_no, 'warning' AS severity, 'flip: event ' || a || ' -> ' || b AS title FROM R WHERE a <> b")
def r7_colon(spark, sf):
    return recipes.flips(colon_log(spark, sf), "event")


@query("a25_correlate", L + "SELECT file, event = 'error' AS with_event, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM L GROUP BY ALL")
def a25(spark, sf):
    return trend.correlate(event_log(spark, sf), "value", "EVENT=error")


@query("a25_correlate_values", L + ", C AS (SELECT component = 'svc-1' AS with_event, event AS value, count(*) AS n FROM L GROUP BY ALL), R AS (SELECT *, row_number() OVER (PARTITION BY with_event ORDER BY n DESC, value) AS rank FROM C) SELECT * FROM R WHERE rank <= 15")
def a25_values(spark, sf):
    return trend.correlate_values(event_log(spark, sf), "event", "[SVC-1]")


@query("a26_recurring_templates", L + r""", T AS (SELECT substr(trim(regexp_replace(regexp_replace(regexp_replace(substr(text, 24), '\d+', '#', 'g'), '#[#\s.:,_\-/]*#', '#', 'g'), '\s+', ' ', 'g')), 1, 120) AS template, event, crash FROM L)
SELECT template, count(*) AS n, CASE WHEN any_value(crash) = 'unhandled' THEN 'unhandled exception' ELSE '] event=' || any_value(event) || ' user_id=' END AS literal FROM T GROUP BY template HAVING count(*) >= 5 ORDER BY n DESC, template LIMIT 12""")
def a26(spark, sf):
    return trend.recurring_templates(event_log(spark, sf))


@query("a27_top_repeats", D + r"SELECT regexp_replace(regexp_replace(text, '^[0-9:.\-T ]+', ''), '\d+', '#', 'g') AS key, count(*) AS n FROM D GROUP BY key ORDER BY n DESC, key LIMIT 20")
def a27(spark, sf):
    return trend.top_repeats(document_lines(spark, sf))


REPEATED = r"regexp_replace(regexp_replace(text, '^[0-9:.\-T ]+', ''), '\d+', '#', 'g')"


@query("a28_preflight", H + f""", K AS (SELECT file, 'repeats' AS section, {REPEATED} AS item FROM H UNION ALL SELECT file, 'tags', component FROM H UNION ALL SELECT file, 'fields', unnest(['event', 'user_id', 'value', 'k']) FROM H UNION ALL SELECT file, 'fields', 'panic' FROM H WHERE crash = 'panic'),
N AS (SELECT file, section, item, count(*) AS n FROM K GROUP BY ALL), T AS (SELECT *, row_number() OVER (PARTITION BY file, section ORDER BY n DESC, item) AS place FROM N),
E AS (SELECT file, text, line_no, row_number() OVER (PARTITION BY file ORDER BY line_no) AS place FROM H WHERE event = 'error')
SELECT file, section, place, item, n, NULL AS line_no FROM T WHERE place <= 5 UNION ALL SELECT file, 'first errors', place, text, NULL, line_no FROM E WHERE place <= 5 UNION ALL SELECT file, 'level', 1, level, count(*), min(line_no) FROM H GROUP BY ALL
UNION ALL SELECT file, 'lines', 1, CAST(count(*) AS VARCHAR), count(*), NULL FROM H GROUP BY file UNION ALL SELECT file, 'longest', 1, CAST(max(length(text)) AS VARCHAR), max(length(text)), NULL FROM H GROUP BY file
UNION ALL SELECT DISTINCT file, 'format', 1, 'keyvalue', NULL, NULL FROM H WHERE line_no < 5 UNION ALL SELECT file, 'first time', 1, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g'), NULL, min(line_no) FROM H GROUP BY file
UNION ALL SELECT file, 'last time', 1, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g'), NULL, max(line_no) FROM H GROUP BY file""")
def a28(spark, sf):
    return investigate.preflight(halves(spark, sf))


GAPS = L + ", G AS (SELECT file, line_no, lag(line_no) OVER (ORDER BY line_no) AS prev_line, abs(ms - lag(ms) OVER (ORDER BY line_no)) / 1000.0 AS gap_seconds, ts, level, crash, component, text FROM L) "
SUMS = GAPS + ", S AS (SELECT count(*) AS lines, count(*) FILTER (level IN ('error', 'fatal')) AS errors, count(*) FILTER (level = 'warning') AS warnings, count(crash) AS crashes, count(DISTINCT component) FILTER (level IN ('error', 'fatal')) AS failing, count(*) FILTER (gap_seconds >= 60) AS gaps, coalesce(max(gap_seconds) FILTER (gap_seconds >= 60), 0) AS longest_gap FROM G) "


@query("a29_triage", SUMS + "SELECT 'events' AS file, *, round(errors * 100.0 / lines, 4) AS error_percent, CASE WHEN crashes > 0 OR errors * 100.0 / lines > 20 THEN 'critical' WHEN errors * 100.0 / lines > 5 OR longest_gap > 300 OR failing > 3 THEN 'warning' ELSE 'ok' END AS severity FROM S")
def a29(spark, sf):
    return profile.triage(event_log(spark, sf))


@query("a30_evidence_pack", SUMS + """, C AS (SELECT component, count(*) FILTER (level IN ('error', 'fatal')) AS e FROM L GROUP BY component), P AS (SELECT line_no, gap_seconds FROM G WHERE gap_seconds >= 60 ORDER BY gap_seconds DESC, line_no LIMIT 10)
SELECT 'events' AS file, lines, errors, crashes, (SELECT string_agg(component, ',' ORDER BY e DESC, component DESC) FROM (SELECT * FROM C WHERE e > 0 ORDER BY e DESC, component LIMIT 10)) AS failing, (SELECT string_agg(line_no, ',' ORDER BY gap_seconds DESC, line_no DESC) FROM P) AS silences, 'event,k' || (SELECT CASE WHEN count(*) > 0 THEN ',panic' ELSE '' END FROM L WHERE crash = 'panic') || ',user_id,value' AS fields FROM S""")
def a30(spark, sf):
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f].cast("string")), ",").alias(c)
    pack = extend.evidence_pack(parsed_log(spark, sf))
    fields = F.array_join(F.array_sort(F.transform("fields", lambda x: x["name"])), ",").alias("fields")
    return pack.select("file", "lines", "errors", "crashes", names("components", "component").alias("failing"), names("silences", "line_no"), fields)


@query("a31_investigate_component", L + """, M AS (SELECT * FROM L WHERE component = 'svc-7'), S AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY line_no) - 1 AS r, count(*) OVER (PARTITION BY level) AS n FROM M),
X AS (SELECT line_no FROM S WHERE level = 'error' AND (n <= 10 OR r IN (SELECT i * n // 10 FROM (SELECT unnest(range(0, 10)) AS i)))),
E AS (SELECT component, count(*) FILTER (level IN ('error', 'fatal')) AS e, min(line_no) FILTER (level IN ('error', 'fatal')) AS f FROM L GROUP BY component), T AS (SELECT * FROM E WHERE e > 0 ORDER BY e DESC, component LIMIT 5)
SELECT 'events' AS file, 'level' AS section, 1 AS place, level AS item, count(*) AS n, min(line_no) AS line_no FROM M GROUP BY level
UNION ALL SELECT 'events', 'sample', 1, text, NULL, line_no FROM S WHERE n <= 5 OR r IN (SELECT i * n // 5 FROM (SELECT unnest(range(0, 5)) AS i))
UNION ALL SELECT 'events', 'error site', 1, string_agg(l.text, chr(10) ORDER BY l.line_no), count(*), X.line_no FROM X JOIN L l ON l.line_no BETWEEN X.line_no - 5 AND X.line_no + 5 GROUP BY X.line_no
UNION ALL SELECT 'events', 'first seen', 1, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%g'), NULL, min(line_no) FROM M UNION ALL SELECT 'events', 'last seen', 1, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%g'), NULL, max(line_no) FROM M
UNION ALL SELECT 'events', 'top failer', 1, component, e, f FROM T WHERE component = 'svc-7'""")
def a31(spark, sf):
    return investigate.component(parsed_log(spark, sf), "[SVC-7]")


@query("a32_investigate_timerange", L + f""", W AS (SELECT * FROM L WHERE line_no BETWEEN (SELECT min(line_no) FROM L WHERE ts >= TIMESTAMP '2024-01-05 00:00:00') AND (SELECT max(line_no) FROM L WHERE ts <= TIMESTAMP '2024-01-15 00:00:00')),
G AS (SELECT line_no, CAST(round(abs(ms - lag(ms) OVER (ORDER BY line_no)) / 1000.0) AS BIGINT) AS s, abs(ms - lag(ms) OVER (ORDER BY line_no)) / 1000.0 AS g FROM W), P AS (SELECT *, row_number() OVER (ORDER BY g DESC, line_no) AS r FROM G WHERE g >= 30),
S AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY line_no) - 1 AS r, count(*) OVER (PARTITION BY level) AS n FROM W WHERE level IN ('error', 'warning'))
SELECT 'events' AS file, 'level' AS section, 1 AS place, level AS item, count(*) AS n, min(line_no) AS line_no FROM W GROUP BY level UNION ALL SELECT 'events', 'crash', 1, CASE WHEN crash = 'unhandled' THEN 'exception' ELSE crash END, NULL, line_no FROM W WHERE crash IS NOT NULL
UNION ALL SELECT 'events', 'silence', r, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END, NULL, line_no FROM P WHERE r <= 10
UNION ALL SELECT 'events', 'first lines', line_no - (SELECT min(line_no) FROM W) + 1, text, NULL, line_no FROM W WHERE line_no < (SELECT min(line_no) FROM W) + 5
UNION ALL SELECT 'events', 'last lines', (SELECT max(line_no) FROM W) - line_no + 1, text, NULL, line_no FROM W WHERE line_no > (SELECT max(line_no) FROM W) - 5
UNION ALL SELECT 'events', 'sample', 1, level || ': ' || text, NULL, line_no FROM S WHERE n <= 20 OR r IN (SELECT i * n // 20 FROM (SELECT unnest(range(0, 20)) AS i))""")
def a32(spark, sf):
    return investigate.timerange(parsed_log(spark, sf), "2024-01-05 00:00:00", "2024-01-15 00:00:00")


@query("a33_investigate_crashes", L + "SELECT 'events' AS file, h.line_no AS hit_line, h.crash AS keyword, count(*) AS lines, string_agg(l.text, chr(10) ORDER BY l.line_no) AS context FROM L h JOIN L l ON l.line_no BETWEEN h.line_no - 5 AND h.line_no + 5 WHERE h.crash IS NOT NULL GROUP BY ALL")
def a33(spark, sf):
    lines = event_log(spark, sf)
    sites = profile.crash_sites(lines)
    return proximity.context_windows(sites, lines, 5).join(sites.select("file", F.col("line_no").alias("hit_line"), "keyword"), ["file", "hit_line"])


@query("a34_conclude", GAPS + """, E AS (SELECT line_no, 'crash' AS kind, crash AS detail FROM G WHERE crash IS NOT NULL UNION ALL SELECT min(line_no), 'first-error', component FROM G WHERE level IN ('error', 'fatal') GROUP BY component
UNION ALL SELECT line_no, 'gap', CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END FROM (SELECT line_no, CAST(round(gap_seconds) AS BIGINT) AS s FROM G WHERE gap_seconds >= 30 ORDER BY gap_seconds DESC, line_no LIMIT 5)),
P AS (SELECT 'events' AS file, *, CAST(row_number() OVER (ORDER BY line_no, kind, detail) AS INTEGER) AS place FROM E) SELECT * FROM P WHERE place <= 40""")
def a34(spark, sf):
    return profile.conclude(event_log(spark, sf))


@query("a34_verdict", L + """, R AS (SELECT *, CASE WHEN crash IS NOT NULL THEN 'crashed' WHEN event = 'error' THEN 'storming' WHEN event = 'purchase' THEN 'stalled' WHEN event = 'signup' THEN 'warned' ELSE 'clean' END AS f FROM L)
SELECT f AS file, CASE f WHEN 'crashed' THEN 'crash' WHEN 'storming' THEN 'error-storm' WHEN 'stalled' THEN 'stall' WHEN 'warned' THEN 'warnings' ELSE 'clean' END AS verdict, count(*) FILTER (level IN ('error', 'fatal')) AS errors, count(*) FILTER (level = 'warning') AS warnings FROM R GROUP BY f""")
def a34_verdict(spark, sf):
    """One file for each verdict; those that must not stall carry no times, and the one that stalls has none in every
    other minute, so that it stalls however close its lines are."""
    lines = event_log(spark, sf)
    kind = F.regexp_extract("text", r"event=(\w+)", 1)
    file = F.when(F.col("text").rlike("panic|unhandled"), "crashed").when(kind == "error", "storming").when(kind == "purchase", "stalled").when(kind == "signup", "warned").otherwise("clean")
    silent = kind.isin("signup", "view", "click") | ((file == "stalled") & (F.substring("text", 15, 2).cast("int") % 2 == 1))
    text = F.when(silent, F.expr("substring(text, 25)")).otherwise(F.col("text"))
    return profile.conclusion_verdict(lines.select(file.alias("file"), "line_no", text.alias("text"))).select("file", "verdict", "errors", "warnings")


def usage(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("feature"), F.when(F.col("user_id") % 3 == 0, "ai").otherwise("human").alias("actor"), "ts")


@query("a35_usage_rollup", "SELECT event_type AS feature, count(*) FILTER (user_id % 3 <> 0) AS human, count(*) FILTER (user_id % 3 = 0) AS ai, count(*) AS total, max(ts) AS last_used FROM events GROUP BY event_type")
def a35(spark, sf):
    return recipes.usage_rollup(usage(spark, sf))


@query("a35_usage_days", "SELECT CAST(ts AS DATE) AS day, count(*) AS uses FROM events WHERE date_diff('day', CAST(ts AS DATE), (SELECT max(CAST(ts AS DATE)) FROM events)) < 14 GROUP BY day")
def a35_days(spark, sf):
    return recipes.usage_days(usage(spark, sf), 14)


@query("a36_pattern_stats", "SELECT event_type AS source, count(*) AS applied, CAST(sum(user_id) AS BIGINT) AS scanned, CAST(sum(event_id % 10) AS BIGINT) AS matched, CAST(sum(event_id % 7) AS BIGINT) AS ms, count(*) FILTER (event_id % 13 = 0) AS invalid FROM events GROUP BY event_type")
def a36(spark, sf):
    e = table(spark, sf, "events")
    return recipes.pattern_stats(e.select(F.col("event_type").alias("source"), F.col("user_id").alias("scanned"), (F.col("event_id") % 10).alias("matched"), (F.col("event_id") % 7).alias("ms"), (F.col("event_id") % 13 != 0).alias("ok")))


@query("a37_variance", L + "SELECT component, round(var_pop(value), 6) AS variance FROM L GROUP BY component")
def a37(spark, sf):
    rows = event_log(spark, sf).select(parse.component("text").alias("component"), parse.to_num(parse.field("text", "value")).alias("v"))
    return rows.groupBy("component").agg(F.round(F.var_pop("v"), 6).alias("variance"))


@query("a38_field_summary", L + "SELECT file, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS average FROM L GROUP BY file")
def a38(spark, sf):
    return trend.field_summary(event_log(spark, sf), "value")


# --- sequences ----------------------------------------------------------------------------------

PREVIEW = "CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS preview"


@query("w1_time_gaps", GAPS + f"SELECT file, line_no, prev_line, gap_seconds, ts, {PREVIEW} FROM G WHERE gap_seconds >= 600")
def w1(spark, sf):
    return sequence.time_gaps(event_log(spark, sf), 600, CHUNK)


@query("w2_bounded_gaps", L + f", G AS (SELECT file, line_no, lag(line_no) OVER (ORDER BY line_no) AS prev_line, abs(ms - lag(ms) OVER (ORDER BY line_no)) / 1000.0 AS gap_seconds, ts, text FROM L WHERE line_no BETWEEN (SELECT min(line_no) FROM L WHERE contains(text, 'k=33')) AND (SELECT min(line_no) FROM L WHERE contains(text, 'value=99') AND line_no >= (SELECT min(line_no) FROM L WHERE contains(text, 'k=33')))) SELECT file, line_no, prev_line, gap_seconds, ts, {PREVIEW} FROM G WHERE gap_seconds >= 10")
def w2(spark, sf):
    return sequence.bounded_gaps(event_log(spark, sf), 10, "k=33", "value=99", CHUNK)


ARRIVALS = L + ", I AS (SELECT line_no, ms, ms - lag(ms) OVER (ORDER BY line_no) AS d FROM L WHERE event = 'purchase'), P AS (SELECT count(*) AS n, median(d / 1000.0) FILTER (d > 0) AS period, min(d / 1000.0) FILTER (d > 0) AS lo, max(d / 1000.0) FILTER (d > 0) AS hi, (max(ms) - min(ms)) / 1000.0 AS span FROM I) "


@query("w3_cadence", ARRIVALS + "SELECT 'events' AS file, n AS occurrences, period, lo AS min_interval, hi AS max_interval, span, CAST(floor(round(span / period, 6) + 0.5) AS BIGINT) + 1 AS expected FROM P")
def w3(spark, sf):
    return sequence.cadence(event_log(spark, sf), "event=purchase", CHUNK)


@query("w3_cadence_misses", ARRIVALS + "SELECT 'events' AS file, line_no, d / 1000.0 AS interval, greatest(1, CAST(floor(round(d / 1000.0 / period, 9) + 0.5) AS BIGINT) - 1) AS missing FROM I, P WHERE d / 1000.0 >= period * 1.5")
def w3_misses(spark, sf):
    return sequence.cadence_misses(event_log(spark, sf), "event=purchase", chunk=CHUNK)


@query("w4_cadence_drift", ARRIVALS + ", R AS (SELECT d, row_number() OVER (ORDER BY line_no) - 1 AS r, count(*) OVER () AS n FROM I WHERE d > 0) SELECT 'events' AS file, median(d) FILTER (r < floor(n / 3)) AS early_ms, median(d) FILTER (r >= n - floor(n / 3)) AS late_ms FROM R")
def w4(spark, sf):
    return sequence.cadence_drift(event_log(spark, sf), "event=purchase", CHUNK)


@query("w5_carry_forward", L + ", B AS (SELECT file, line_no, CASE WHEN line_no % 5 = 3 THEN ms END AS own FROM L), F AS (SELECT *, count(own) OVER (ORDER BY line_no) AS g FROM B) SELECT file, line_no, coalesce(max(own) OVER (PARTITION BY g), (SELECT own FROM B WHERE own IS NOT NULL ORDER BY line_no LIMIT 1)) AS filled FROM F")
def w5(spark, sf):
    rows = event_log(spark, sf).select("file", "line_no", F.when(F.col("line_no") % 5 == 3, parse.epoch_ms(parse.parse_ts("text"))).alias("own"))
    return sequence.carry_forward(rows, "own", "filled", CHUNK).select("file", "line_no", "filled")


@query("w6_even_sample", L + ", R AS (SELECT file, line_no, row_number() OVER (ORDER BY line_no) - 1 AS r, count(*) OVER () AS n FROM L WHERE event = 'click') SELECT file, line_no FROM R WHERE r IN (SELECT i * (SELECT max(n) FROM R) // 97 FROM (SELECT unnest(range(0, 97)) AS i))")
def w6(spark, sf):
    rows = event_log(spark, sf).where(F.contains("text", F.lit("event=click"))).select("file", "line_no")
    return sequence.even_sample(rows, 97, CHUNK)


@query("w7_transitions", L + ", R AS (SELECT file, line_no, lag(event) OVER (ORDER BY line_no) AS from_value, event AS to_value FROM L WHERE k % 2 = 0) SELECT * FROM R WHERE from_value <> to_value")
def w7(spark, sf):
    rows = event_log(spark, sf).where(F.col("text").rlike(r"k=\d*[02468](\s|$)"))
    return sequence.transitions(rows, parse.field("text", "event"), CHUNK)


@query("w7_role_transitions", "SELECT 'conv-' || conv_id AS file, turn AS line_no, lag(role) OVER w AS from_value, role AS to_value FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn) QUALIFY from_value <> to_value")
def w7_roles(spark, sf):
    rows = table(spark, sf, "conversations").select(F.concat(F.lit("conv-"), "conv_id").alias("file"), F.col("turn").alias("line_no"), "role")
    return sequence.transitions(rows, F.col("role"))


@query("w8_escalations", L + ", R AS (SELECT file, line_no, component, lag(level) OVER (PARTITION BY component ORDER BY line_no) AS from_level, level AS to_level FROM L) SELECT * FROM R WHERE (from_level = 'info' AND to_level IN ('warning', 'error')) OR (from_level = 'warning' AND to_level = 'error')")
def w8(spark, sf):
    return sequence.escalations(event_log(spark, sf), CHUNK)


@query("w9_spread", "WITH R AS (SELECT event_id AS line_no, epoch_ms(date_trunc('hour', ts)) AS ms FROM events), T AS (SELECT ms, count(*) AS n, lead(ms) OVER (ORDER BY ms) AS nx FROM R GROUP BY ms) SELECT line_no, ms, round(coalesce(ms + (row_number() OVER (PARTITION BY ms ORDER BY line_no) - 1) / n * (nx - ms) * 0.85, ms), 3) AS spread_ms FROM R JOIN T USING (ms)")
def w9(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), F.unix_millis(F.date_trunc("hour", F.col("ts").cast("timestamp"))).alias("ms"))
    return sequence.spread_equal_times(rows).withColumn("spread_ms", F.round("spread_ms", 3))


@query("w10_repair_monotonic", "SELECT 'e' AS file, event_id AS line_no, max(CASE WHEN value BETWEEN 1 AND 120 THEN CAST(event_id + floor(value) AS BIGINT) END) OVER (ORDER BY event_id) AS repaired FROM events")
def w10(spark, sf):
    t = F.when(F.col("value").between(1, 120), (F.col("event_id") + F.floor("value")).cast("long")).otherwise(-1)
    rows = table(spark, sf, "events").select(F.lit("e").alias("file"), F.col("event_id").alias("line_no"), t.alias("t"))
    return sequence.repair_monotonic(rows, "t", 0, 1 << 60, CHUNK).select("file", "line_no", "repaired")


@query("w11_display_index", L + "SELECT file, line_no, row_number() OVER (ORDER BY line_no) - 1 AS display_index FROM L WHERE component = 'svc-0'")
def w11(spark, sf):
    return sequence.display_index(search.scope_component(event_log(spark, sf), "svc-0").select("file", "line_no"), CHUNK)


@query("w12_monotonicity", L + ", R AS (SELECT value, lag(value) OVER (ORDER BY line_no) AS p FROM L) SELECT 'events' AS file, round(avg(CASE WHEN value >= p THEN 1.0 ELSE 0.0 END), 6) AS monotone, count(*) AS pairs FROM R WHERE p IS NOT NULL")
def w12(spark, sf):
    rows = event_log(spark, sf).select("file", "line_no", parse.to_num(parse.field("text", "value")).alias("v"))
    return sequence.monotonicity(rows, "v", CHUNK)


@query("w13_runs", L + ", R AS (SELECT line_no, level, line_no - row_number() OVER (PARTITION BY level ORDER BY line_no) AS g FROM L WHERE event IN ('click', 'view')) SELECT 'events' AS file, min(line_no) AS start_line, count(*) AS lines, level AS state FROM R GROUP BY level, g")
def w13(spark, sf):
    rows = event_log(spark, sf).select("file", "line_no", parse.detect_level("text").alias("level")).where("level in ('debug', 'trace')")
    return sequence.runs(rows, "level", CHUNK)


# --- recipes and investigations -----------------------------------------------------------------


DOMAIN_TEXT = ["ActivityManager: Displayed I/foo", "HardFault at 0xdeadbeef", "GET /index HTTP 200 req_id=7", "CAN frame lost, DTC 12", "nothing special"]
DOMAIN_LINES = "WITH T AS (SELECT 'log' || (o_custkey % 5) AS file, CASE WHEN o_orderkey % 7 < 5 THEN CASE o_custkey % 5 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(DOMAIN_TEXT)) + " END ELSE 'plain' END AS text FROM orders) "


@query("r0_detect_domain", DOMAIN_LINES + ", H AS (" + " UNION ALL ".join(f"SELECT file, '{d}' AS domain, CAST(sum(len(regexp_extract_all(text, '(?i){p}'))) AS BIGINT) AS hits FROM T GROUP BY file" for d, p in recipes.DETECT.items())
       + ") SELECT file, CASE WHEN max(hits) >= 2 THEN arg_max(domain, hits * 10 + CASE domain WHEN 'android' THEN 1 WHEN 'automotive' THEN 2 WHEN 'embedded' THEN 3 ELSE 4 END) ELSE 'generic' END AS domain, max(hits) AS hits FROM H GROUP BY file")
def r0(spark, sf):
    o = table(spark, sf, "orders")
    c = F.col("o_custkey") % 5
    text = F.when(F.col("o_orderkey") % 7 < 5, F.coalesce(*[F.when(c == k, t) for k, t in enumerate(DOMAIN_TEXT)])).otherwise("plain")
    return recipes.detect_domain(o.select(F.concat(F.lit("log"), c).alias("file"), F.col("o_orderkey").alias("line_no"), text.alias("text")))


CRASHES = "SELECT file, max(line_no) AS line_no, 'critical' AS severity, 'final crash line' AS title FROM L WHERE crash IS NOT NULL GROUP BY file UNION ALL SELECT file, min(line_no), 'error', crash FROM L WHERE crash IS NOT NULL GROUP BY file, crash"


@query("r1_crash", L + CRASHES)
def r1(spark, sf):
    return recipes.crash(event_log(spark, sf))


@query("r1_crash_markers", "SELECT 'web' AS file, o_orderkey AS line_no, 'error' AS severity, 'crash marker' AS title FROM orders WHERE o_orderkey % 4 = 1")
def r1_markers(spark, sf):
    """A log without crash words: the domain's markers stand for them."""
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 4 == 1, "worker was OOMKilled").otherwise(F.col("o_orderstatus"))
    return recipes.crash(o.select(F.lit("web").alias("file"), F.col("o_orderkey").alias("line_no"), text.alias("text")), "web")


@query("r2_hang", GAPS + ", S AS (SELECT file, line_no, CAST(round(gap_seconds) AS BIGINT) AS s FROM G WHERE gap_seconds >= 30 ORDER BY gap_seconds DESC, line_no LIMIT 10) SELECT file, line_no, 'warning' AS severity, 'silence of ' || CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' END AS title FROM S")
def r2(spark, sf):
    return recipes.hang(event_log(spark, sf))


@query("r3_slow", L + "SELECT file, line_no, 'warning' AS severity, 'value at ' || printf('%.2f', value) AS title FROM L ORDER BY value DESC, line_no LIMIT 10")
def r3(spark, sf):
    return recipes.slow(event_log(spark, sf), "value")


@query("r3_slow_discovered", "SELECT 'web' AS file, o_orderkey AS line_no, 'warning' AS severity, 'latency_ms at ' || printf('%.2f', o_custkey + 0.5) AS title FROM orders ORDER BY o_custkey DESC, o_orderkey LIMIT 10")
def r3_discovered(spark, sf):
    o = table(spark, sf, "orders")
    text = F.concat(F.lit("took=x total_ms="), F.col("o_orderkey"), F.lit(" latency_ms="), F.format_string("%.1f", F.col("o_custkey") + 0.5))
    return recipes.slow(o.select(F.lit("web").alias("file"), F.col("o_orderkey").alias("line_no"), text.alias("text")), domain="web")


@query("r4_error_storm", ERRORS + "SELECT file, first_error AS line_no, 'error' AS severity, 'first error of ' || component AS title FROM E WHERE errors > 0 ORDER BY errors DESC, component LIMIT 5")
def r4(spark, sf):
    return recipes.error_storm(event_log(spark, sf))


@query("r5_wont_start", L + "SELECT file, line_no, 'info' AS severity, 'start of the log' AS title FROM L WHERE line_no = 0")
def r5(spark, sf):
    return recipes.wont_start(event_log(spark, sf))


@query("r6_connection_drops", "SELECT 'orders' AS file, o_orderkey AS line_no, 'warning' AS severity, 'connection trouble' AS title FROM orders WHERE o_orderkey % 17 = 3")
def r6(spark, sf):
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 17 == 3, "peer: Connection RESET by host").otherwise(F.col("o_orderpriority"))
    return recipes.connection_drops(o.select(F.lit("orders").alias("file"), F.col("o_orderkey").alias("line_no"), text.alias("text")))


@query("r7_flips", L + ", R AS (SELECT line_no, lag(event) OVER (ORDER BY line_no) AS a, event AS b FROM L) SELECT 'events' AS file, line_no, 'warning' AS severity, 'flaky: event ' || a || ' -> ' || b AS title FROM R WHERE a <> b")
def r7(spark, sf):
    return recipes.flips(event_log(spark, sf), "event", "flaky")


UI = L + """, R AS (SELECT line_no, lag(event) OVER (ORDER BY line_no) AS a, event AS b FROM L), U AS (SELECT 'events' AS file, line_no, 'info' AS severity, 'logged state "event"' AS title FROM L
  UNION ALL SELECT 'events', line_no, 'warning', 'state change: event ' || a || ' -> ' || b FROM R WHERE a <> b) """


@query("r9_ui_state", UI + "SELECT * FROM U")
def r9(spark, sf):
    return recipes.ui_state(event_log(spark, sf), ["event"])


@query("r9_ui_expectation", UI + "SELECT * FROM U UNION ALL SELECT 'events', line_no, 'info', 'logged state \"purchase\"' FROM L WHERE event = 'purchase'")
def r9_expectation(spark, sf):
    return recipes.ui_state(event_log(spark, sf), expectation="The event should be shown when a purchase appears, event and all")


@query("r10_report", L + ", F AS (" + CRASHES + ") SELECT *, CAST(row_number() OVER (ORDER BY line_no, title) AS INTEGER) AS place, line_no + 1 AS viewer_line, greatest(0, line_no - 20) AS from_line, line_no + 15 AS to_line, CASE severity " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in recipes.NEXT.items()) + " END AS next_question FROM F")
def r10(spark, sf):
    return recipes.report(recipes.crash(event_log(spark, sf)))


@query("r11_domain_markers", L + ", T AS (SELECT file, text FROM L UNION ALL SELECT 'orders', CASE WHEN o_orderkey % 17 = 3 THEN 'peer: Connection RESET by host, watchdog' ELSE o_orderpriority END FROM orders), M AS ("
       + " UNION ALL ".join(f"SELECT file, '{d}' AS domain, '{k}' AS kind, count(*) FILTER (regexp_matches(text, '(?i){p}')) AS hits FROM T GROUP BY file" for d, pack in recipes.PACKS.items() for k, p in pack.items()) + ") SELECT * FROM M WHERE hits > 0")
def r11(spark, sf):
    o = table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 17 == 3, "peer: Connection RESET by host, watchdog").otherwise(F.col("o_orderpriority"))
    return recipes.domain_markers(event_log(spark, sf).unionByName(o.select(F.lit("orders").alias("file"), F.col("o_orderkey").alias("line_no"), text.alias("text"))))


@query("i1_replay", GAPS + "SELECT 0 AS step, 'filter' AS verb, count(*) AS rows FROM L WHERE level IN ('error', 'fatal') UNION ALL SELECT 1, 'search', count(*) FROM L WHERE level IN ('error', 'fatal') AND contains(text, 'k=4') UNION ALL SELECT 2, 'crashes', count(*) FROM L WHERE crash IS NOT NULL UNION ALL SELECT 3, 'levels', 7")
def i1(spark, sf):
    steps = [
        {"verb": "filter", "args": {"levels": ["error", "fatal"]}, "scope": True},
        {"verb": "search", "args": {"pattern": "k=1"}, "params": {"pattern": "needle"}},
        {"verb": "crashes"}, {"verb": "levels"},
    ]
    return recipes.replay(event_log(spark, sf), steps, {"needle": "k=4"}).select("step", "verb", "rows")


@query("i1_replay_outcomes", GAPS + """SELECT 0 AS step, 'search' AS verb, count(*) AS rows, true AS ok FROM L WHERE contains(text, 'event=error') UNION ALL SELECT 1, 'search', 0, false UNION ALL SELECT 2, 'no such verb', 0, false
UNION ALL SELECT 3, 'crashes', count(*), true FROM L WHERE crash IS NOT NULL AND event = 'error' UNION ALL SELECT 4, 'levels', 0, false UNION ALL SELECT 5, 'search', count(*), true FROM L WHERE event = 'error' AND contains(text, 'k=4')""")
def i1_outcomes(spark, sf):
    """A shared scope, and steps that cannot run: a bad pattern, an unknown verb, an unknown argument."""
    steps = [
        {"verb": "search", "args": {"pattern": "event=error"}, "scope": True}, {"verb": "search", "args": {"pattern": "(", "regex": True}, "scope": True}, {"verb": "no such verb"},
        {"verb": "crashes"}, {"verb": "levels", "args": {"depth": 3}}, {"verb": "search", "args": {"pattern": "k=4"}},
    ]
    return recipes.replay(event_log(spark, sf), steps).select("step", "verb", "rows", "ok")


@query("p18_voted_columns", L + "SELECT line_no, strftime(ts, '%Y-%m-%d') AS c1, strftime(ts, '%H:%M:%S.%g') AS c2, CASE event WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' WHEN 'purchase' THEN 'INFO' WHEN 'click' THEN 'DEBUG' ELSE 'TRACE' END AS c3, component AS c4 FROM L")
def p18_voted(spark, sf):
    """Columns without an example: date, time, level and component of the log, by a vote of its lines."""
    found = extend.columns_by_example(event_log(spark, sf))
    return found.select("line_no", "c1", "c2", "c3", "c4")


@query("i2_requirements", H + "SELECT file, round(avg(CASE WHEN event = 'click' THEN 1.0 ELSE 0 END), 6) AS match_rate, avg(CASE WHEN event = 'click' THEN 1.0 ELSE 0 END) >= 0.4 AS columns, bool_or(crash = 'panic') IS TRUE AS signature, true AS named, true AS format, 0 AS unverified, NOT (avg(CASE WHEN event = 'click' THEN 1.0 ELSE 0 END) >= 0.4 AND bool_or(crash = 'panic') IS TRUE) AS blocked FROM H GROUP BY file")
def i2(spark, sf):
    return recipes.check_requirements(halves(spark, sf), r"event=click user_id=\d+", "panic", "APP*.log", "keyvalue", least=0.4)


@query("i2_unverified", H + "SELECT DISTINCT file, CAST(NULL AS DOUBLE) AS match_rate, CAST(NULL AS BOOLEAN) AS columns, CAST(NULL AS BOOLEAN) AS signature, false AS named, CAST(NULL AS BOOLEAN) AS format, 2 AS unverified, true AS blocked FROM H")
def i2_unverified(spark, sf):
    return recipes.check_requirements(halves(spark, sf), "(open", "[", "other?.log")


@query("i4_clue_sequence", L + "SELECT o_custkey AS sequence, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS place, line_no, level, ts FROM orders JOIN L ON L.line_no = o_orderkey")
def i4(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select(F.lit("events").alias("file"), F.col("o_orderkey").alias("line_no"), F.col("o_custkey").alias("sequence"))
    rows = proximity.resolve_marks(o, event_log(spark, sf)).where("text is not null")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("sequence").orderBy("line_no"))).select("sequence", "place", "line_no", "level", "ts")


# --- baselines, extension points ------------------------------------------------------------------


@query("k6_baseline_store", H + """SELECT 'run of ' || file AS name, CASE WHEN file LIKE 'host0%' THEN 'second' ELSE 'first' END AS note, count(*) AS total_lines, CAST(count(*) FILTER (level = 'fatal') AS BIGINT) AS fatal FROM H GROUP BY file""")
def k6(spark, sf):
    """Fingerprints of all files saved under names, one saved again, one of another name saved and
    deleted; the newest of each name that is left."""
    from ..sources import sinks
    from ..sources.store import scratch

    prints = profile.fingerprint(halves(spark, sf)).select("file", "total_lines", F.col("levels")["fatal"].alias("fatal")).collect()  # a row for each file
    path = scratch(spark, "baselines")
    schema = "file string, total_lines long, fatal long, note string"
    save = lambda row, note, name, when: sinks.save_baseline(spark.createDataFrame([(*row, note)], schema), path, name, when)
    for row in prints:
        save(row, "first", f"run of {row['file']}", "2024-01-01 00:00:00")
        if row["file"].startswith("host0"):
            save(row, "second", f"run of {row['file']}", "2024-01-02 00:00:00")
            save(row, "first", "discarded", "2024-01-02 00:00:00")
            sinks.delete_baseline(spark, path, "discarded", "2024-01-03 00:00:00")
    return sinks.list_baselines(spark.read.parquet(path)).select("name", "note", "total_lines", "fatal")


@query("u1_analyzer", L + "SELECT component, count(*) AS slow FROM L WHERE value > 100 GROUP BY component")
def u1(spark, sf):
    slow = lambda lines: lines.where(parse.to_num(parse.field("text", "value")) > 100).groupBy(parse.component("text").alias("component")).agg(F.count(F.lit(1)).alias("slow"))
    extend.register_analyzer("slow-components", slow)
    return extend.analyze(event_log(spark, sf), "slow-components")


@query("u2_custom_redaction", L + "SELECT line_no, replace(text, 'user_id=' || user_id, 'user_id=***') AS text FROM L")
def u2(spark, sf):
    from ..operators import redact

    return redact.custom(event_log(spark, sf), [(r"user_id=\d+", "user_id=***")]).select("line_no", "text")


@query("u3_search_library", "WITH T AS (SELECT c_custkey AS line_no, n_name AS text FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT r_name AS pattern_id, count(*) AS lines FROM T, region WHERE regexp_matches(text, '[' || r_name || ']{3}') GROUP BY r_name")
def u3(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("text"))
    c = table(spark, sf, "customer")
    lines = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.lit("customers").alias("file"), F.col("c_custkey").alias("line_no"), "text")
    library = table(spark, sf, "region").select(F.col("r_name").alias("pattern_id"), F.concat(F.lit("["), "r_name", F.lit("]{3}")).alias("pattern"))
    return extend.search_library(lines, library).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("lines"))


@query("u3_pattern_library", L + r""", U AS (SELECT line_no, CAST(regexp_extract(text, 'user_id=(\d+)', 1) AS BIGINT) AS u FROM L),
X AS (SELECT p_partkey AS k, line_no FROM part JOIN U ON u = p_partkey WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, line_no FROM part JOIN U ON u IN (p_partkey, p_partkey + 7) WHERE p_partkey % 3 = 1)
SELECT CAST(k AS VARCHAR) AS pattern_id, count(*) AS lines, min(line_no) AS first_line FROM X GROUP BY k""")
def u3_parts(spark, sf):
    """A pattern for each part: a user's number, either of two users, and no valid one."""
    k, n = F.col("p_partkey").cast("string"), F.col("p_partkey")
    either = F.concat(F.lit("USER_ID=(?:"), k, F.lit("|"), (n + 7).cast("string"), F.lit(") "))
    pattern = F.when(n % 3 == 0, F.concat(F.lit("user_id="), k, F.lit(r"\b"))).when(n % 3 == 1, either).otherwise(F.concat(F.lit("user_id=("), k))
    patterns = table(spark, sf, "part").select(k.alias("pattern_id"), pattern.alias("pattern"))
    found = extend.search_library(event_log(spark, sf), patterns, case=False)
    return found.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line"))


@query("u4_table_functions", L + "SELECT 'matches' AS of, count(*) AS n, sum(strpos(text, 'panic') - 1) AS total FROM L WHERE contains(text, 'panic') UNION ALL SELECT 'levels', count(*), sum(length(text)) FROM L WHERE event = 'error'")
def u4_functions(spark, sf):
    """Table functions called in SQL on a table, with a pattern and a level as arguments."""
    extend.register_table_functions(spark)
    event_log(spark, sf).createOrReplaceTempView("u4_log")
    return spark.sql("""SELECT 'matches' AS of, count(*) AS n, sum(`column`) AS total FROM log_matches(TABLE(u4_log), 'pan[i]c')
        UNION ALL SELECT 'levels', count(*), sum(length(text)) FROM log_level(TABLE(u4_log), 'error')""")


@query("u4_gaps_function", GAPS + "SELECT line_no, gap_seconds FROM G WHERE gap_seconds >= 900")
def u4_gaps(spark, sf):
    """A table function over each file's lines in order; its argument is partitioned and ordered by the caller."""
    extend.register_table_functions(spark)
    event_log(spark, sf).createOrReplaceTempView("u4_log")
    return spark.sql("SELECT line_no, gap_seconds FROM log_gaps(TABLE(SELECT file, floor(line_no / 4000) AS part, line_no, text FROM u4_log) PARTITION BY (file, part) ORDER BY (line_no), 900D) UNION ALL " + U4_EDGES)


#: Gaps across the edges of the parts: the last and first line of neighbouring parts.
U4_EDGES = """SELECT b.line_no, abs(unix_millis(cast(substr(b.text, 1, 23) AS timestamp)) - unix_millis(cast(substr(a.text, 1, 23) AS timestamp))) / 1000 AS gap_seconds
FROM u4_log a JOIN u4_log b ON a.file = b.file AND b.line_no = a.line_no + 1 WHERE b.line_no % 4000 = 0
AND abs(unix_millis(cast(substr(b.text, 1, 23) AS timestamp)) - unix_millis(cast(substr(a.text, 1, 23) AS timestamp))) / 1000 >= 900"""


@query("u4_sql_views", GAPS + "SELECT 'gaps' AS view, count(*) AS n FROM G WHERE gap_seconds >= 30 UNION ALL SELECT 'crashes', count(crash) FROM L UNION ALL SELECT 'components', count(DISTINCT component) FROM L UNION ALL SELECT 'fatal lines', count(*) FROM L WHERE level = 'fatal'")
def u4(spark, sf):
    extend.register_views(spark, parsed_log(spark, sf), "u4")
    return spark.sql("SELECT 'gaps' AS view, count(*) AS n FROM u4_gaps UNION ALL SELECT 'crashes', count(*) FROM u4_crashes UNION ALL SELECT 'components', count(*) FROM u4_components UNION ALL SELECT 'fatal lines', count(*) FROM u4_lines WHERE level = 'fatal'")


@query("p18_columns_by_example", L + "SELECT file, line_no, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS stamp, regexp_extract(text, ' ([A-Z]+) ', 1) AS word, component AS tag, event AS what, CAST(user_id AS VARCHAR) AS who FROM L")
def p18(spark, sf):
    lines = event_log(spark, sf)
    sample = lines.orderBy("line_no").select("text").first()["text"]
    find = lambda part, after=0: (sample.index(part, after), sample.index(part, after) + len(part))
    word, tag = sample[24:].split(" ")[:2]
    what, who = (sample.split(f"{k}=")[1].split(" ")[0] for k in ("event", "user_id"))
    spans = {"stamp": (0, 23), "word": find(word, 24), "tag": find(tag, 24), "what": find(what, sample.index("event=")), "who": find(who, sample.index("user_id="))}
    return extend.columns_by_example(lines, sample, spans)
