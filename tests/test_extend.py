from __future__ import annotations

import random

from pyspark.sql import functions as F

from tracewell.functions import parse
from tracewell.operators import extend, investigate, profile, proximity, recipes, redact, search, sequence, trend
from tracewell.sources import readers


def lines(spark, texts, file="t.log"):
    return spark.createDataFrame([(file, k, t) for k, t in enumerate(texts)], "file string, line_no long, text string").repartition(3)


def test_numbered_redaction_counts_in_order_of_first_sight(spark):
    texts = ["from 10.0.0.2 to 10.0.0.1", "plain", "10.0.0.1 wrote to a@b.org", "a@b.org 10.0.0.22 10.0.0.2"]
    got = [r.text for r in redact.numbered(lines(spark, texts), chunk=2).orderBy("line_no").collect()]
    assert got == ["from [IP-1] to [IP-2]", "plain", "[IP-2] wrote to [EMAIL-1]", "[EMAIL-1] [IP-3] [IP-1]"]
    assert [r.text for r in redact.custom(lines(spark, ["secret-42 x"]), [(r"secret-\d+", "[ID]")]).collect()] == ["[ID] x"]


def test_columns_by_example(spark):
    texts = ["10:00:01 <alpha> n=5", "10:00:02 <beta> n=17", "other"]
    got = extend.columns_by_example(lines(spark, texts), texts[0], {"clock": (0, 8), "tag": (9, 16), "n": (19, 20)}).orderBy("line_no").collect()
    assert [(r.clock, r.tag, r.n) for r in got] == [("10:00:01", "alpha", "5"), ("10:00:02", "beta", "17"), (None, None, None)]


def test_libraries_analyzers_views_and_packs(spark):
    log = lines(spark, ["2024-01-01 10:00:00 ERROR [net] v=1", "2024-01-01 10:05:00 INFO [net] v=2", "2024-01-01 10:05:01 ERROR [db] panic v=3"])
    library = spark.createDataFrame([("e", "ERROR"), ("n", r"\[net\]")], "pattern_id string, pattern string")
    assert sorted((r.line_no, r.pattern_id) for r in extend.search_library(log, library).collect()) == [(0, "e"), (0, "n"), (1, "n"), (2, "e")]
    extend.register_analyzer("count", lambda d: d.agg(F.count(F.lit(1)).alias("n")))
    assert extend.analyze(log, "count").first().n == 3
    extend.register_views(spark, log, "x")
    assert spark.sql("select count(*) from x_lines where level in ('error', 'fatal')").first()[0] == 2
    assert spark.sql("select gap_seconds from x_gaps").first()[0] == 300.0
    pack = extend.evidence_pack(log).first()
    assert pack.severity == "critical" and pack.silences[0].gap_seconds == 300.0 and pack.fields[0].name == "v"
    assert extend.compare_windows(log, (2, 2), (0, 1)).where("category = 'new-crash'").count() == 1


def test_numbers_follow_lines_however_long_they_are(spark):
    texts = ["x" * 150_000 + " 10.0.0.9", "10.0.0.1"]
    got = [r.text[-6:] for r in redact.numbered(lines(spark, texts), chunk=1).orderBy("line_no").collect()]
    assert got == ["[IP-1]", "[IP-2]"]


def test_patterns_are_checked_by_the_engine_that_runs_them(spark):
    log = lines(spark, ["ÄÖ x=1 aa", "b x=2", "$5.00 \\d"])
    assert search.compile_pattern(r"(?P<x>a)", regex=True) is None and search.compile_pattern(r"\p{Lu}+", regex=True) is not None
    assert [r.line_no for r in search.search(log, r"^\p{Lu}+", regex=True).collect()] == [0]
    assert search.search(log, "(?P<x>a)", regex=True).count() == 0 and search.search_all(log, "(", regex=True).count() == 0
    assert [(r.column, r.length) for r in search.search_all(log, "a*", regex=True).collect()] == [(7, 2)]
    assert [(r.line_no, r.column) for r in search.search_all(log, "$5.").collect()] == [(2, 0)]
    found = search.search_all(log, r"\d|x", regex=True).orderBy("line_no", "column").collect()
    assert [(r.line_no, r.column) for r in found] == [(0, 3), (0, 5), (1, 2), (1, 4), (2, 1), (2, 3), (2, 4)]


def test_fields_of_json_colon_and_equal_lines(spark):
    log = lines(spark, ['{"value": 3, "mode": "a b", "deep": {"x": 1}, "none": null}', "value: 4 mode: 'c'", 'value = 5, mode = "d e"', "value=6", "{not json value=7", "2024-01-01 10:00:00 [net] other=1"])
    rows = {r.line_no: r for r in log.select("line_no", parse.field("text", "value").alias("v"), parse.field("text", "mode").alias("m"), parse.extract_fields("text").alias("f")).collect()}
    assert [rows[k].v for k in range(6)] == ["3", "4", "5", "6", "7", None]
    assert [rows[k].m for k in range(3)] == ["a b", "c", "d e"]
    assert rows[0].f == {"value": "3", "mode": "a b", "deep": '{"x":1}'} and rows[5].f == {"other": "1"} and "none" not in rows[0].f
    assert sorted(r.value for r in trend.largest(log, "value", 3).collect()) == [5.0, 6.0, 7.0]


def test_stored_facts_give_what_text_gives(spark):
    texts = ["2024-01-01 10:00:00 ERROR [net] boom", "2024-01-01 10:00:40 WARN [net] x", "# comment", "", "FATAL [db] panic v=1", "2024-01-01 10:09:00 INFO [db] fine"]
    log = lines(spark, texts)
    kept = readers.parsed(log)
    verbs = [profile.triage, profile.level_counts, profile.crash_sites, profile.fingerprint, sequence.time_gaps, sequence.escalations, investigate.preflight, investigate.analyze, profile.conclude]
    for verb in verbs:
        a, b = (sorted(map(str, verb(x).collect())) for x in (log, kept))
        assert a == b, verb.__name__


def test_hunks_of_two_logs(spark):
    left = lines(spark, ["a", "b", "c", "d", "e", "x", "f"])
    right = lines(spark, ["a", "c", "d", "new", "e", "y", "z", "f", "end"])
    got = sorted((r.start_line, r.kind, r.lines, r.other_start) for r in proximity.diff_hunks(left, right, chunk=2).collect())
    assert got == [(0, "equal", 1, 0), (1, "removed", 1, 1), (2, "equal", 2, 1), (3, "added", 1, 4), (4, "equal", 1, 4), (5, "modified", 1, 5), (6, "equal", 1, 7), (8, "added", 1, 7)]


def test_one_field_is_what_all_fields_have_of_it(spark):
    rng = random.Random(12)
    marks = ["k=", "rank=", "k =", "k = ", "k:", "k: ", "(k=", "a=k=", "x=\"k=", "x='k=", "b=[k=", ",k=", ";k=", "=", " ", "  ", "\"", "]", "1", "2", "v,", "{", "}", "z"]
    texts = ["".join(rng.choices(marks, k=rng.randrange(1, 9))) for _ in range(4000)]
    log = lines(spark, texts)
    both = log.select("text", parse.field("text", "k").alias("one"), parse.extract_fields("text")["k"].alias("all"))
    assert both.where("one is not null").count() > 1000
    assert both.where("not (one <=> all)").limit(5).collect() == []


def test_numbers_that_do_not_fit_are_none(spark):
    raw = ["1e999", "-1e999", "12", "-0.5", "1e3", "x", "", None, "9" * 400]
    got = spark.createDataFrame([(r,) for r in raw], "r string").select(parse.to_num("r").alias("n")).collect()
    assert [r.n for r in got] == [None, None, 12.0, -0.5, 1000.0, None, None, None, None]


def test_spans_are_voted_on_three_formats(spark):
    plain = [f"2024-01-0{1 + k % 9} 10:00:0{k % 10} {'INFO' if k % 2 else 'ERROR'} [net{k}] got {k} things" for k in range(30)] + ["  at Frame.one", ""]
    syslog = [f"<{k}> host{k % 3} app[{100 + k}]: started \"unit {k}\"" for k in range(20)]
    access = [f"10.0.0.{k} - - (GET) /p/{k} 200" for k in range(20)]
    names = {"plain": plain, "syslog": syslog, "access": access}
    cells = {}
    for name, texts in names.items():
        rows = extend.columns_by_example(lines(spark, texts)).where("line_no = 7").collect()
        cells[name] = [v for c, v in rows[0].asDict().items() if c not in ("file", "line_no")]
    assert cells["plain"][:5] == ["2024-01-08", "10:00:07", "INFO", "net7", "got"]
    assert cells["syslog"][:4] == ["7", "host1", "app", "107"] and "unit 7" in cells["syslog"]
    assert cells["access"][0] == "10.0.0.7" and "GET" in cells["access"] and "p/7" in cells["access"]
    assert extend.vote_spans(lines(spark, ["", " "])) is None
    given = extend.columns_by_example(lines(spark, ["a [b] c", "d [e] f"]), "a [b] c").collect()
    assert sorted(tuple(r)[2:] for r in given) == [("a", "b", "c"), ("d", "e", "f")]


def test_table_functions(spark):
    extend.register_table_functions(spark, "tf")
    log = lines(spark, ["2024-01-01 10:00:00 ERROR a", "no time", "2024-01-01 10:02:00,500 WARN b", "2024-13-01 10:00:00 x", "2024-01-01 10:01:00 INFO panic"])
    log.createOrReplaceTempView("tf_log")
    gaps = spark.sql("SELECT line_no, prev_line, gap_seconds FROM tf_gaps(TABLE(tf_log) PARTITION BY (file) ORDER BY (line_no), 60D)").collect()
    assert [tuple(r) for r in gaps] == [(2, 0, 120.5), (4, 2, 60.5)]
    assert [r.line_no for r in spark.sql("SELECT * FROM tf_matches(TABLE(tf_log), 'p.nic')").collect()] == [4]
    assert spark.sql("SELECT * FROM tf_matches(TABLE(tf_log), '(')").collect() == []
    assert sorted(r.line_no for r in spark.sql("SELECT * FROM tf_level(TABLE(tf_log), 'warning')").collect()) == [2]


def test_replay_tells_what_could_not_run(spark):
    log = lines(spark, ["x error", "y"])
    got = recipes.replay(log, [{"verb": "search", "args": {"pattern": "["  , "regex": True}}, {}, {"verb": "levels", "scope": True}, {"verb": "search", "args": {"pattern": "y"}}])
    rows = {r.step: (r.ok, r.rows, r.error) for r in got.collect()}
    assert rows[0][:2] == (False, 0) and "invalid pattern" in rows[0][2] and rows[1][0] is False and rows[2][0] is False and rows[3] == (True, 1, None)
    assert recipes.replay(log, []).collect() == []
