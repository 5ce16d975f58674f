"""Queries of sources, sinks, parsing, search and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse
from ..operators import columns, recipes, redact, search
from ..sources import readers, sinks
from ..sources.views import D, L, document_lines, event_log, table
from .base import query

# --- sources ------------------------------------------------------------------------------------


@query("s2_split_headers", D + """, H AS (SELECT file, line_no + 1 AS line_no, text FROM D UNION ALL SELECT DISTINCT file, 0, '#SPLIT:part=1,total=2' FROM D WHERE length(file) % 2 = 0)
SELECT file, CASE WHEN length(file) % 2 = 0 THEN line_no - 1 ELSE line_no END AS line_no, text FROM H WHERE line_no > 0""")
def split_headers(spark, sf):
    lines = document_lines(spark, sf)
    heads = lines.where((F.col("line_no") == 0) & (F.length("file") % 2 == 0)).select("file", "line_no", F.lit("#SPLIT:part=1,total=2").alias("text"))
    return readers.without_split_headers(lines.withColumn("line_no", F.col("line_no") + 1).unionByName(heads))


@query("s2_part_number", "SELECT c_custkey, c_custkey % 13 AS part FROM customer")
def part_number(spark, sf):
    k = F.col("c_custkey")
    name = F.concat(F.lit("/logs/run.v2_part"), (k % 13).cast("string"), F.when(k % 2 == 0, ".log").otherwise(""))
    return table(spark, sf, "customer").select("c_custkey", readers.part_number(name).cast("long").alias("part"))


@query("s3_jsonl", """SELECT event_id AS line_no, CASE WHEN event_id % 7 = 0 THEN 'bad {json' WHEN event_id % 11 = 0 THEN '' ELSE strftime(ts, '%Y-%m-%d') || ' ' || upper(event_type) || ' user ' || user_id || ' k=' || json_extract_string(props, '$.k') END AS text FROM events""")
def jsonl(spark, sf):
    e = table(spark, sf, "events")
    row = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd").alias("time"), F.col("event_type").alias("severity"), F.concat(F.lit("user "), F.col("user_id")).alias("msg"), F.get_json_object("props", "$.k").alias("k")))
    text = F.when(F.col("event_id") % 7 == 0, "bad {json").when(F.col("event_id") % 11 == 0, "").otherwise(row)
    return readers.json_lines(e.select(F.col("event_id").alias("line_no"), text.alias("text")))


@query("s4_log_records", """SELECT strftime(date_trunc('milliseconds', ts), '%Y-%m-%dT%H:%M:%S.%gZ') || ' [' || upper(event_type) || '] svc-' || (user_id % 8) || ' - '
  || CASE WHEN event_id % 2 = 0 THEN 'message ' || event_id ELSE '{"k":' || json_extract_string(props, '$.k') || '}' END AS text FROM events""")
def log_records(spark, sf):
    e = table(spark, sf, "events")
    return readers.log_records(e.select(
        F.when(F.col("event_id") % 3 == 0, F.unix_millis(F.col("ts").cast("timestamp")).cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")).alias("timestamp"),
        F.col("event_type").alias("status"), F.concat(F.lit("svc-"), F.col("user_id") % 8).alias("service"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("message "), F.col("event_id"))).alias("message"), F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"))).alias("rest"),
    ))


@query("s5_compose", D + """, N AS (SELECT file, max(line_no) + 1 AS n FROM D GROUP BY file), S AS (SELECT file, coalesce(sum(n) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM N)
SELECT file, line_no, CAST(s + line_no AS BIGINT) AS global_line_no FROM D JOIN S USING (file)""")
def compose(spark, sf):
    return readers.compose(document_lines(spark, sf)).select("file", "line_no", "global_line_no")


@query("s7_detect_format", D + """, H AS (SELECT file, trim(text) AS t FROM D WHERE line_no < 5 AND trim(text) <> '')
SELECT file, CASE WHEN bool_and(regexp_matches(t, '^\\{.*\\}$')) THEN 'json' WHEN bool_or(regexp_matches(t, '^<\\?xml|^<[A-Za-z]')) THEN 'xml'
  WHEN bool_and(len(regexp_extract_all(t, '[A-Za-z_][A-Za-z0-9_.]*=')) >= 2) THEN 'keyvalue'
  WHEN bool_and(regexp_matches(t, '^[A-Z][a-z]{2}\\s+\\d{1,2}\\s+\\d{2}:\\d{2}:\\d{2}')) THEN 'syslog'
  WHEN min(length(t) - length(replace(t, ',', ''))) = max(length(t) - length(replace(t, ',', ''))) AND min(length(t) - length(replace(t, ',', ''))) >= 1 THEN 'csv' ELSE 'text' END AS format FROM H GROUP BY file""".replace("\\\\", "\\"))
def detect_format(spark, sf):
    return readers.detect_format(document_lines(spark, sf))


@query("s8_get_lines", L + "SELECT file, line_no, text FROM L WHERE line_no BETWEEN 100 AND 349")
def get_lines(spark, sf):
    return readers.get_lines(event_log(spark, sf), 100, 250)


@query("s8_lines_by_numbers", L + "SELECT file, line_no, text FROM L WHERE line_no IN (SELECT o_orderkey FROM orders)")
def lines_by_numbers(spark, sf):
    return readers.get_lines_by_numbers(event_log(spark, sf), table(spark, sf, "orders").select(F.col("o_orderkey").alias("line_no")))


@query("s9_column_table", L + "SELECT file, line_no, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S.%g') AS clock, split_part(text, ' ', 3) AS level, split_part(text, ' ', 4) AS tag FROM L")
def column_table(spark, sf):
    return columns.column_table(event_log(spark, sf), " ", ["day", "clock", "level", "tag"])


def customer_csv(spark, sf):
    """Customers as a delimited log with a header: names in quotes, numbers, flags, empty cells."""
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    text = F.concat_ws(",", (k * 2).cast("string"), F.concat(F.lit('"'), F.col("c_name"), F.lit(', x"')), F.when(k % 3 == 0, "true").otherwise("false"), F.when(k % 2 == 0, F.col("c_mktsegment")).otherwise(""))
    rows = c.select(F.lit("customers.csv").alias("file"), (k + 1).cast("long").alias("line_no"), text.alias("text"))
    return rows.unionByName(c.limit(1).select(F.lit("customers.csv").alias("file"), F.lit(0).cast("long").alias("line_no"), F.lit("time,message,flag,level").alias("text")))


@query("s9_inferred_table", "SELECT 'customers.csv' AS file, c_custkey + 1 AS line_no, CAST(c_custkey * 2 AS DOUBLE) AS time, c_name || ', x' AS message, c_custkey % 3 = 0 AS flag, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS level FROM customer")
def inferred_table(spark, sf):
    return columns.column_table(customer_csv(spark, sf), ",")


@query("p8_analyze_columns", """WITH C AS (SELECT unnest([{'p': 0, 'name': 'time', 'role': 'timestamp', 'type': 'numeric', 'v': CAST(c_custkey * 2 AS VARCHAR)}, {'p': 1, 'name': 'message', 'role': 'message', 'type': 'string', 'v': c_name || ', x'},
  {'p': 2, 'name': 'flag', 'role': 'other', 'type': 'boolean', 'v': CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END}, {'p': 3, 'name': 'level', 'role': 'level', 'type': 'string', 'v': CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END}]) AS c, c_custkey FROM customer),
V AS (SELECT c.p AS place, c.name AS name, c.role AS role, c.type AS type, c.v AS v, count(*) AS n, min(c_custkey) AS f FROM C WHERE c.v <> '' GROUP BY ALL), R AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY f, v) AS r FROM V)
SELECT 'customers.csv' AS file, place, name, role, type, CAST(sum(n) AS BIGINT) AS "values", string_agg(v, '|' ORDER BY r) FILTER (r <= 5) AS samples FROM R GROUP BY place, name, role, type""")
def analyze_columns(spark, sf):
    return columns.analyze_columns(customer_csv(spark, sf))


# --- sinks --------------------------------------------------------------------------------------


@query("k1_extract", L + "SELECT file, line_no, (line_no + 1) || chr(9) || text AS value FROM L WHERE level IN ('error', 'fatal')")
def extract(spark, sf):
    return sinks.extract(search.filter_basic(event_log(spark, sf), ["error", "fatal"]))


@query("k2_save_range", L + "SELECT file, line_no, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 3) || ' ' || array_to_string(string_split(text, ' ')[5:], ' ') AS value FROM L WHERE line_no BETWEEN 50 AND 5000")
def save_range(spark, sf):
    return sinks.save_range(event_log(spark, sf), 50, 5000, " ", [True, False, True, False])


@query("k3_split_output", L + ", P AS (SELECT file, line_no // ((SELECT max(line_no) + 1 FROM L) + 6) // 1 AS z, CAST(floor(line_no / ceil((SELECT max(line_no) + 1 FROM L) / 7.0)) + 1 AS BIGINT) AS part FROM L) SELECT file, part, count(*) AS lines, 7 AS total, 'app_part' || part || '.log' AS name, CASE WHEN part > 1 THEN 'app_part' || (part - 1) || '.log' END AS prev, CASE WHEN part < 7 THEN 'app_part' || (part + 1) || '.log' END AS next FROM P GROUP BY file, part")
def split_output(spark, sf):
    return sinks.part_names(sinks.split_output(event_log(spark, sf), "parts", 7), "app", ".log")


@query("k4_timeline_text", L + "SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%g') || ' | events | ' || text AS value, ts, file, line_no FROM L")
def timeline_text(spark, sf):
    from ..operators.proximity import merge_timeline

    return sinks.timeline_text(merge_timeline(event_log(spark, sf)))


@query("k5_export_marks", L + "SELECT 'events' AS file, o_orderkey AS line_no, o_orderpriority AS label, text FROM orders LEFT JOIN L ON L.line_no = o_orderkey")
def export_marks(spark, sf):
    marks = table(spark, sf, "orders").select(F.lit("events").alias("file"), F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("label"))
    return sinks.export_marks(marks, event_log(spark, sf))


@query("k6_list_baselines", "SELECT o_custkey AS name, max(o_orderkey) AS version FROM orders GROUP BY o_custkey HAVING max_by(o_orderkey % 5, o_orderkey) <> 0")
def list_baselines(spark, sf):
    o = table(spark, sf, "orders")
    stored = o.select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("version"), F.timestamp_seconds(F.col("o_orderkey")).alias("updated_at"), (F.col("o_orderkey") % 5 == 0).alias("deleted"))
    return sinks.list_baselines(stored).select("name", "version")


# --- parsing ------------------------------------------------------------------------------------


@query("p1_parse_ts", L + "SELECT line_no, ts, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS ts_str FROM L")
def parse_ts(spark, sf):
    return event_log(spark, sf).select("line_no", parse.parse_ts("text").alias("ts"), parse.ts_str("text").alias("ts_str"))


@query("p1_parse_euro", "SELECT event_id AS line_no, date_trunc('second', ts) AS ts FROM events")
def parse_euro(spark, sf):
    text = F.concat(F.lit("x "), F.date_format("ts", "dd.MM.yyyy HH:mm:ss"), F.lit(" y"))
    return table(spark, sf, "events").select(F.col("event_id").alias("line_no"), parse.parse_ts(text).alias("ts"))


@query("p1_parse_syslog", "SELECT event_id AS line_no, date_trunc('second', ts) AS ts FROM events")
def parse_syslog(spark, sf):
    text = F.concat(F.date_format("ts", "MMM  d HH:mm:ss"), F.lit(" host app: x")).alias("text")
    return table(spark, sf, "events").select(F.col("event_id").alias("line_no"), text).select("line_no", parse.parse_ts("text", 2024).alias("ts"))


@query("p2_parse_ts_seconds", "SELECT event_id AS line_no, date_trunc('second', ts) AS ts FROM events")
def parse_seconds(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("line_no"), parse.parse_ts_seconds(F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS")).alias("ts"))


@query("p3_detect_level", L + "SELECT line_no, level, level AS analyzer, CASE WHEN level IN ('fatal', 'error', 'warning') THEN level END AS severity FROM L")
def detect_level(spark, sf):
    return event_log(spark, sf).select("line_no", parse.detect_level("text").alias("level"), parse.detect_level("text", "analyzer").alias("analyzer"), parse.detect_level("text", "severity").alias("severity"))


@query("p4_normalize_level", "SELECT event_id, CASE event_type WHEN 'error' THEN 'fatal' WHEN 'signup' THEN 'verbose' WHEN 'purchase' THEN 'info' WHEN 'click' THEN 'trace' END AS level FROM events")
def normalize_level(spark, sf):
    raw = {"error": "emerg", "signup": "finer", "purchase": "informational", "click": "silly", "view": "other"}
    word = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in raw.items()])
    return table(spark, sf, "events").select("event_id", parse.normalize_level(word).alias("level"))


@query("p5_crash_keyword", L + "SELECT line_no, crash AS analyzer, crash AS traceback, CASE WHEN crash = 'unhandled' THEN 'exception' ELSE crash END AS listed FROM L WHERE crash IS NOT NULL")
def crash_keyword(spark, sf):
    cols = [parse.crash_keyword("text", v).alias(n) for v, n in (("analyzer", "analyzer"), ("traceback", "traceback"), ("list", "listed"))]
    return event_log(spark, sf).select("line_no", *cols).where("analyzer is not null or traceback is not null or listed is not null")


@query("p6_split_columns", L + "SELECT line_no, len(string_split(text, ' ')) AS cells, split_part(text, ' ', 5) AS fifth FROM L")
def split_columns(spark, sf):
    c = parse.split_columns("text", " ")
    return event_log(spark, sf).select("line_no", F.size(c).alias("cells"), F.get(c, F.lit(4)).alias("fifth"))


@query("p6_quoted_columns", "SELECT c_custkey, c_name || ', \"x\"' AS a, '' AS b, c_mktsegment AS c, 4 AS cells FROM customer")
def quoted_columns(spark, sf):
    text = F.concat(F.lit('"'), F.col("c_name"), F.lit(', ""x""",,'), F.col("c_mktsegment"), F.lit(",1"))
    c = parse.split_columns(text, ",")
    return table(spark, sf, "customer").select("c_custkey", *[F.get(c, F.lit(k)).alias(n) for k, n in enumerate("abc")], F.size(c).alias("cells"))


@query("p7_project_columns", "SELECT c_custkey, '\"' || c_name || ', 1\",' || c_mktsegment || ',z' AS value FROM customer")
def project_columns(spark, sf):
    text = F.concat(F.lit('"'), F.col("c_name"), F.lit(', 1",hidden,'), F.col("c_mktsegment"), F.lit(",z"))
    return table(spark, sf, "customer").select("c_custkey", parse.project_columns(text, ",", [True, False]).alias("value"))


@query("p8_delimiter_scores", L + """, C AS (SELECT line_no, regexp_matches(text, '\\d{2}:\\d{2}') AS timed, d.delimiter, length(text) - length(replace(text, d.c, '')) AS n
  FROM L, (VALUES ('tab', chr(9)), ('comma', ','), ('pipe', '|'), ('semicolon', ';'), ('space', ' '), ('colon', ':')) AS d(delimiter, c) WHERE line_no >= 1),
M AS (SELECT delimiter, n, row_number() OVER (PARTITION BY delimiter ORDER BY count(*) DESC, n) AS r FROM C GROUP BY delimiter, n), U AS (SELECT delimiter, n AS usual FROM M WHERE r = 1)
SELECT C.delimiter, round(avg(n) * avg(CASE WHEN n = usual THEN 1.0 ELSE 0 END) * avg(CASE WHEN n > 0 THEN 1.0 ELSE 0 END) * CASE WHEN C.delimiter = 'colon' AND avg(CASE WHEN timed THEN 1.0 ELSE 0 END) > 0.8 THEN 0.3 ELSE 1.0 END, 6) AS score, usual
FROM C JOIN U USING (delimiter) GROUP BY C.delimiter, usual""".replace("\\\\", "\\"))
def delimiter_scores(spark, sf):
    return readers.delimiter_scores(event_log(spark, sf))


@query("p9_header_roles", """SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'timestamp' WHEN 1 THEN 'level' WHEN 2 THEN 'message' WHEN 3 THEN 'source' WHEN 4 THEN 'channel' ELSE 'other' END AS role FROM orders""")
def header_roles(spark, sf):
    names = ["LoggerTime", "Severity ", "Msg", "Process", "Component", "Foo"]
    name = F.coalesce(*[F.when(F.col("o_orderkey") % 6 == k, n) for k, n in enumerate(names)])
    return table(spark, sf, "orders").select("o_orderkey", parse.header_role(name).alias("role"))


@query("p10_extract_fields", L + "SELECT line_no, event, CAST(user_id AS VARCHAR) AS user_id, printf('%.2f', value) AS value, CAST(k AS VARCHAR) AS k FROM L")
def extract_fields(spark, sf):
    m = parse.extract_fields("text")
    return event_log(spark, sf).withColumn("m", m).select("line_no", *[F.col("m")[n].alias(n) for n in ("event", "user_id", "value", "k")])


@query("p11_field", L + "SELECT line_no, event, component AS tag, 'value=' AS whole FROM L")
def field(spark, sf):
    return event_log(spark, sf).select("line_no", parse.field("text", "event").alias("event"), parse.matched("text", r"\[(svc-\d)\]").alias("tag"), parse.matched("text", "value=").alias("whole"))


VALUES = ["2.1", "-5", "TRUE", "[a,b]", "idle", "1e5", "1e999", "false"]


@query("p12_classify_value", "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'numeric' WHEN 1 THEN 'numeric' WHEN 2 THEN 'boolean' WHEN 3 THEN 'array' WHEN 4 THEN 'string' WHEN 5 THEN 'numeric' WHEN 6 THEN 'numeric' ELSE 'boolean' END AS kind, CASE o_orderkey % 8 WHEN 0 THEN 2.1 WHEN 1 THEN -5.0 WHEN 5 THEN 100000.0 END AS num FROM orders")
def classify_value(spark, sf):
    raw = F.coalesce(*[F.when(F.col("o_orderkey") % 8 == k, v) for k, v in enumerate(VALUES)])
    return table(spark, sf, "orders").select("o_orderkey", parse.classify_value(raw).alias("kind"), parse.to_num(raw).alias("num"))


@query("p13_series_num", "SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 2.1 WHEN 1 THEN -5.0 WHEN 2 THEN 1.0 WHEN 5 THEN 100000.0 WHEN 7 THEN 0.0 END AS num FROM orders")
def series_num(spark, sf):
    raw = F.coalesce(*[F.when(F.col("o_orderkey") % 8 == k, v) for k, v in enumerate(VALUES)])
    return table(spark, sf, "orders").select("o_orderkey", parse.series_num(raw).alias("num"))


@query("p14_relative_seconds", "SELECT event_id, CAST(printf('%.2f', value) AS DOUBLE) AS seconds FROM events")
def relative_seconds(spark, sf):
    return table(spark, sf, "events").select("event_id", parse.relative_seconds(F.format_string("  %.2f boot", "value")).alias("seconds"))


@query("p15_axis_value", L + "SELECT line_no, CAST(line_no AS DOUBLE) AS by_line, CAST(ms AS DOUBLE) AS by_time, value AS by_field FROM L")
def axis_value(spark, sf):
    return event_log(spark, sf).select("line_no", parse.axis_value("line").alias("by_line"), parse.axis_value("time").alias("by_time"), parse.axis_value("field:value").alias("by_field"))


@query("p16_grok", L + "SELECT line_no, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M:%S.%g') AS clock, split_part(text, ' ', 3) AS level, component AS tag, array_to_string(string_split(text, ' ')[5:], ' ') AS rest FROM L")
def grok(spark, sf):
    pattern, names = parse.grok(r"%{date} %{clock} %{level:[A-Z]+} [%{tag}] %{rest}")
    return event_log(spark, sf).select("line_no", *parse.pattern_columns("text", pattern, names))


@query("p17_regex_columns", L + "SELECT line_no, event AS what, CAST(user_id AS VARCHAR) AS who FROM L WHERE event <> 'view' UNION ALL SELECT line_no, NULL, NULL FROM L WHERE event = 'view'")
def regex_columns(spark, sf):
    return event_log(spark, sf).select("line_no", *parse.pattern_columns("text", r"event=(?P<what>[a-u]\w+) user_id=(?P<who>\d+)"))


@query("p18_common_prefix", L + "SELECT 'svc-' AS prefix, component FROM (SELECT DISTINCT component FROM L)")
def common_prefix(spark, sf):
    from ..operators.trend import same_column

    rows = event_log(spark, sf).select(parse.component("text").alias("component"))
    shared = rows.agg(same_column(F.col("component")).alias("prefix"))
    return rows.distinct().join(F.broadcast(shared)).select("prefix", "component")


@query("p20_match_rate", L + "SELECT file, CAST(sum(CASE WHEN event = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS matched, count(*) AS scanned, round(avg(CASE WHEN event = 'click' THEN 1.0 ELSE 0 END), 6) AS rate FROM L GROUP BY file")
def match_rate(spark, sf):
    return search.pattern_match_rate(event_log(spark, sf), "event=click")


PATTERNS = {"clicks": "event=click", "errors": r"(?i)\berror\b", "nested": r"(panic)+", "odd": ".*exception", "sevens": "7"}
BATCH = L + """, B AS (SELECT line_no, text, p.id FROM L, (VALUES ('clicks'), ('errors'), ('nested'), ('odd'), ('sevens')) AS p(id) WHERE CASE p.id WHEN 'clicks' THEN event = 'click' WHEN 'errors' THEN event = 'error'
  WHEN 'nested' THEN contains(text, 'panic') WHEN 'odd' THEN contains(text, 'exception') ELSE contains(text, '7') END)
"""


AUDITED = {
    **PATTERNS, "bad": "(open", "quiet": "no such text", "not view": {"pattern": "EVENT=view", "case": False, "invert": True},
    "any tag": {"pattern": "[svc-?]", "wildcard": True}, "word": {"pattern": "event", "word": True},
}


@query("p21_pattern_audit", L + """, P AS (SELECT * FROM (VALUES ('clicks', true, ''), ('errors', true, ''), ('nested', true, ''), ('odd', true, 'leading .*'), ('sevens', true, ''), ('bad', false, 'invalid'), ('quiet', true, ''), ('not view', true, ''), ('any tag', true, ''), ('word', true, '')) AS p(id, valid, warning)),
B AS (SELECT line_no, id, CASE id WHEN 'sevens' THEN length(text) - length(replace(text, '7', '')) > 1 ELSE false END AS twice FROM L, P WHERE CASE id WHEN 'clicks' THEN event = 'click' WHEN 'errors' THEN event = 'error' WHEN 'nested' THEN contains(text, 'panic')
  WHEN 'odd' THEN contains(text, 'exception') WHEN 'sevens' THEN contains(text, '7') WHEN 'not view' THEN event <> 'view' WHEN 'any tag' THEN true WHEN 'word' THEN true ELSE false END)
SELECT id AS pattern_id, valid, count(line_no) AS matched, (SELECT count(*) FROM L) AS scanned, round(count(line_no) / (SELECT count(*) FROM L), 6) AS share, min(line_no) AS first_line, max(line_no) AS last_line,
  CAST(sum(CASE WHEN id = 'errors' AND line_no IS NOT NULL OR twice THEN 1 ELSE 0 END) AS BIGINT) AS multi, warning FROM P LEFT JOIN B USING (id) GROUP BY id, valid, warning""")
def pattern_audit(spark, sf):
    return search.pattern_audit(event_log(spark, sf), AUDITED)


@query("p23_line_template", L + r"SELECT line_no, substr(trim(regexp_replace(regexp_replace(regexp_replace(substr(text, 24), '\d+', '#', 'g'), '#[#\s.:,_\-/]*#', '#', 'g'), '\s+', ' ', 'g')), 1, 120) AS template FROM L")
def line_template(spark, sf):
    return event_log(spark, sf).select("line_no", parse.line_template("text").alias("template"))


@query("p24_template_literal", L + r"""SELECT line_no, CASE event WHEN 'view' THEN '] event=view user_id=' WHEN 'click' THEN '] event=click user_id=' WHEN 'purchase' THEN '] event=purchase user_id=' WHEN 'signup' THEN '] event=signup user_id='
  ELSE CASE crash WHEN 'unhandled' THEN 'unhandled exception' ELSE '] event=error user_id=' END END AS literal FROM L""")
def template_literal(spark, sf):
    rows = event_log(spark, sf)
    return rows.select("line_no", parse.template_literal(F.regexp_replace("text", r"\d+", "#")).alias("literal"))


@query("p25_noise_key", L + r"SELECT line_no, regexp_replace(regexp_replace(text, '^[0-9:.\-T ]+', ''), '\d+', '#', 'g') AS key FROM L")
def noise_key(spark, sf):
    return event_log(spark, sf).select("line_no", parse.noise_key("text").alias("key"))


@query("p26_redact_counts", D + r"""SELECT file, count(*) AS lines, CAST(sum(len(regexp_extract_all(text, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b'))) AS BIGINT) AS ips, CAST(sum(len(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'))) AS BIGINT) AS emails
  FROM D GROUP BY file HAVING ips + emails > 0""")
def redact_counts(spark, sf):
    t = parse.redact_hashed("text")
    n = lambda p: F.sum(F.regexp_count("t", F.lit(rf"\[{p}-[0-9a-f]{{8}}\]"))).cast("long")
    return document_lines(spark, sf).withColumn("t", t).groupBy("file").agg(F.count(F.lit(1)).alias("lines"), n("IP").alias("ips"), n("EMAIL").alias("emails")).where("ips + emails > 0")


@query("p26_redact_numbered", """WITH T AS (SELECT o_orderkey AS line_no, '10.0.' || (o_custkey % 200) || '.7' AS a, '10.1.' || (o_orderkey % 50) || '.9' AS b, 'u' || (o_custkey % 30) || '@x.org' AS m FROM orders),
V AS (SELECT line_no, 1 AS pos, 'IP' AS prefix, a AS v FROM T UNION ALL SELECT line_no, 2, 'IP', b FROM T UNION ALL SELECT line_no, 3, 'EMAIL', m FROM T),
S AS (SELECT prefix, v, min(line_no * 4 + pos) AS f FROM V GROUP BY ALL), N AS (SELECT v, '[' || prefix || '-' || row_number() OVER (PARTITION BY prefix ORDER BY f) || ']' AS name FROM S)
SELECT 'orders' AS file, line_no, 'src=' || x.name || ' dst=' || y.name || ' by ' || z.name || ' ok' AS text FROM T JOIN N x ON x.v = a JOIN N y ON y.v = b JOIN N z ON z.v = m""")
def redact_numbered(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit("src=10.0."), c % 200, F.lit(".7 dst=10.1."), k % 50, F.lit(".9 by u"), c % 30, F.lit("@x.org ok"))
    return redact.numbered(table(spark, sf, "orders").select(F.lit("orders").alias("file"), k.alias("line_no"), text.alias("text")))


@query("p27_mute", L + "SELECT file, line_no, text FROM L WHERE event NOT IN ('view', 'click')")
def mute(spark, sf):
    return search.mute(event_log(spark, sf), ["EVENT=view", "event=CLICK ", "  "])


@query("p28_formats", L + """, S AS (SELECT line_no, ts, CAST(round(value) AS BIGINT) AS s FROM L) SELECT line_no, strftime(ts, '%Y-%m-%d %H:%M:%S.%g') AS clock,
  CASE WHEN s * 31 < 60 THEN (s * 31) || 's' WHEN s * 31 < 3600 THEN (s * 31 // 60) || 'm ' || (s * 31 % 60) || 's' ELSE (s * 31 // 3600) || 'h ' || (s * 31 % 3600 // 60) || 'm' END AS duration FROM S""")
def formats(spark, sf):
    rows = event_log(spark, sf).withColumn("s", F.round(parse.to_num(parse.field("text", "value"))) * 31)
    return rows.select("line_no", parse.wall_clock(parse.parse_ts("text")).alias("clock"), parse.duration_text("s").alias("duration"))


@query("p29_origin_tags", "SELECT 'x/' || (c_custkey % 50) || '/app' || (c_custkey % 7) || '.log' AS file, (c_custkey % 50) || '/app' || (c_custkey % 7) || '.log' AS origin FROM customer GROUP BY ALL")
def origin_tags(spark, sf):
    from ..operators.proximity import origin_tags as tags

    k = F.col("c_custkey")
    return tags(table(spark, sf, "customer").select(F.concat(F.lit("x/"), k % 50, F.lit("/app"), k % 7, F.lit(".log")).alias("file")))


@query("p30_components", L + "SELECT line_no, component, component AS bracket, component AS simple FROM L")
def components(spark, sf):
    c = parse.component("text")
    return event_log(spark, sf).select("line_no", c.alias("component"), parse.bracket_component("text").alias("bracket"), parse.simplify_source(F.concat(c, F.lit(".inner.x"))).alias("simple"))


@query("p31_keywords", "SELECT o_orderkey, 'status,' || lower(substr(replace(o_orderpriority, ' ', ''), 3)) || ',login' AS words FROM orders")
def keywords(spark, sf):
    text = F.concat(F.lit("The STATUS should be "), F.replace("o_orderpriority", F.lit(" "), F.lit("")), F.lit(" when login, status shown"))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(parse.keywords(text), ",").alias("words"))


# --- search and filters -------------------------------------------------------------------------


@query("f1_search", L + "SELECT file, line_no, CAST(strpos(text, 'event=p') - 1 AS INTEGER) AS \"column\", 7 AS length, text FROM L WHERE contains(text, 'event=p')")
def f1(spark, sf):
    return search.search(event_log(spark, sf), "event=p")


@query("f1_search_word", L + "SELECT file, line_no, CAST(strpos(lower(text), 'error') - 1 AS INTEGER) AS \"column\", 5 AS length, text FROM L WHERE event = 'error'")
def f1_word(spark, sf):
    return search.search(event_log(spark, sf), "error", case=False, word=True)


@query("f2_search_all", L + ", C AS (SELECT file, line_no, text, unnest(range(1, length(text) + 1)) AS i FROM L) SELECT file, line_no, CAST(i - 1 AS INTEGER) AS \"column\", 2 AS length FROM C WHERE substr(text, i, 2) = '=1'")
def f2(spark, sf):
    return search.search_all(event_log(spark, sf), "=1")


@query("f3_hidden_matches", L + "SELECT file, line_no, CAST(strpos(text, 'svc-3') - 1 AS INTEGER) AS \"column\", 5 AS length, text FROM L WHERE component = 'svc-3'")
def f3(spark, sf):
    return search.hidden_column_matches(event_log(spark, sf), "svc-3", " ", [True, True, True, False])


@query("f4_search_in_filter", L + ", V AS (SELECT line_no, row_number() OVER (ORDER BY line_no) - 1 AS display_index FROM L WHERE level IN ('error', 'fatal', 'warning')) SELECT file, L.line_no, display_index, display_index IS NOT NULL AS visible FROM L LEFT JOIN V USING (line_no) WHERE contains(text, 'k=5')")
def f4(spark, sf):
    lines = event_log(spark, sf)
    shown = search.filter_basic(lines, ["error", "fatal", "warning"])
    return search.search_in_filter(search.search(lines, "k=5"), shown).select("file", "line_no", "display_index", "visible")


@query("f5_search_batch", BATCH + "SELECT id AS pattern_id, count(*) AS matches, min(line_no) AS first_line FROM B GROUP BY id")
def f5(spark, sf):
    return search.batch_counts(event_log(spark, sf), PATTERNS)


@query("f6_grouped_batch", BATCH + "SELECT 'events' AS file, line_no, string_agg(id, ',' ORDER BY id) AS patterns FROM B GROUP BY line_no")
def f6(spark, sf):
    return search.grouped_batch(event_log(spark, sf), PATTERNS)


@query("f7_search_folder", D + ", H AS (SELECT file, line_no, CAST(strpos(text, 'the') - 1 AS INTEGER) AS \"column\", text FROM D WHERE contains(text, 'the')) SELECT file, line_no, \"column\", text FROM H")
def f7(spark, sf):
    return search.search_folder(document_lines(spark, sf), "the")


CONTEXT = L + ", H AS (SELECT line_no FROM L WHERE level IN ('error', 'fatal') AND contains(text, 'k=9')), X AS (SELECT DISTINCT line_no + d AS line_no FROM H, (SELECT unnest(range(-2, 3)) AS d)) "


@query("f8_filter_basic", CONTEXT + "SELECT file, line_no, text FROM L JOIN X USING (line_no) WHERE event <> 'view'")
def f8(spark, sf):
    return search.filter_basic(event_log(spark, sf), ["error", "fatal"], ["K=9"], ["event=view"], context=2)


@query("f9_filter_advanced", L + "SELECT file, line_no, text FROM L WHERE (event = 'click' OR level IN ('fatal')) AND NOT contains(text, 'svc-1') AND level <> 'error' AND regexp_matches(text, 'k=[0-4]')")
def f9(spark, sf):
    return search.filter_advanced(event_log(spark, sf), [
        {"operator": "OR", "rules": [("contains", "EVENT=CLICK"), ("level", "fatal"), ("regex", "(bad")]},
        {"operator": "AND", "rules": [("not_contains", "svc-1"), ("not_level", "error"), ("regex", "k=[0-4]"), ("not_regex", "(bad")]},
    ])


@query("f10_filter_column", L + "SELECT file, line_no, text FROM L WHERE level = 'info'")
def f10(spark, sf):
    return search.filter_column(event_log(spark, sf), 2, "INFO")


@query("f11_with_context", CONTEXT + "SELECT file, line_no FROM L JOIN X USING (line_no)")
def f11(spark, sf):
    lines = event_log(spark, sf)
    return search.with_context(search.filter_basic(lines, ["error", "fatal"], ["k=9"]), lines, 2).select("file", "line_no")


@query("f12_scope_range", L + "SELECT file, line_no FROM L WHERE line_no BETWEEN 10 AND 700")
def f12(spark, sf):
    return search.scope_range(event_log(spark, sf), 700, 10).select("file", "line_no")


@query("f13_scoped_search", L + "SELECT file, line_no FROM L WHERE event = 'error' AND contains(text, 'k=7')")
def f13(spark, sf):
    lines = event_log(spark, sf)
    return search.scope_of(search.search(lines, "k=7"), search.search(lines, "event=error")).select("file", "line_no")


@query("f14_scope_component", L + "SELECT file, line_no FROM L WHERE component = 'svc-2'")
def f14(spark, sf):
    return search.scope_component(event_log(spark, sf), "svc-2").select("file", "line_no")


@query("f15_scope_time", L + "SELECT file, line_no FROM L WHERE ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-10 12:00:00'")
def f15(spark, sf):
    return search.scope_time(event_log(spark, sf), "2024-01-02 00:00:00", "2024-01-10 12:00:00").select("file", "line_no")


@query("f16_time_window", L + "SELECT file, line_no FROM L WHERE line_no BETWEEN (SELECT min(line_no) FROM L WHERE ts >= TIMESTAMP '2024-01-03 00:00:00') AND (SELECT max(line_no) FROM L WHERE ts <= TIMESTAMP '2024-01-12 00:00:00')")
def f16(spark, sf):
    return search.time_window(event_log(spark, sf), "2024-01-03 00:00:00", "2024-01-12 00:00:00").select("file", "line_no")


@query("f17_compose_scopes", L + "SELECT file, line_no FROM L WHERE component = 'svc-4' AND event = 'click' AND line_no <= 4000")
def f17(spark, sf):
    lines = event_log(spark, sf)
    return search.compose_scopes(search.scope_range(lines, 0, 4000), [search.scope_component(lines, "svc-4"), search.search(lines, "event=click")]).select("file", "line_no")


@query("f18_scoped_levels", L + "SELECT level, count(*) AS lines FROM L WHERE component = 'svc-5' GROUP BY level")
def f18(spark, sf):
    rows = search.scope_component(event_log(spark, sf), "svc-5").withColumn("level", parse.detect_level("text"))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("lines"))


@query("f19_next_problem", L + ", M AS (SELECT DISTINCT o_orderkey AS line_no FROM orders) SELECT 'events' AS file, m.line_no, (SELECT min(p.line_no) FROM L p WHERE p.level IN ('fatal', 'error') AND p.line_no > m.line_no) AS problem_line FROM M m")
def f19(spark, sf):
    marks = table(spark, sf, "orders").select(F.lit("events").alias("file"), F.col("o_orderkey").alias("line_no"))
    return search.next_problem(event_log(spark, sf), marks, least_rank=2, chunk=700)


@query("f19_previous_problem", L + ", M AS (SELECT DISTINCT o_orderkey AS line_no FROM orders) SELECT 'events' AS file, m.line_no, (SELECT max(p.line_no) FROM L p WHERE p.level IN ('fatal', 'error', 'warning') AND p.line_no < m.line_no) AS problem_line FROM M m")
def f19_back(spark, sf):
    marks = table(spark, sf, "orders").select(F.lit("events").alias("file"), F.col("o_orderkey").alias("line_no"))
    return search.next_problem(event_log(spark, sf), marks, forward=False, chunk=700)
