"""The literal cases that fix the verbs' meaning."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tracewell.functions import parse
from tracewell.operators import profile, proximity, recipes, search, sequence, trend
from tracewell.sources import readers


def lines(spark, texts, file="t.log"):
    return spark.createDataFrame([(file, k, t) for k, t in enumerate(texts)], "file string, line_no long, text string").repartition(3)


def numbers(spark, values):
    return spark.createDataFrame([("t.log", v) for v in values], "file string, line_no long")


GAPS = ["2024-01-01 10:00:00 start", "2024-01-01 10:00:05 next", "2024-01-01 10:01:00 later", "no timestamp on this line", "2024-01-01 10:01:02 end"]
SCOPED = [
    "2024-01-01 10:00:00 INFO Server started", "2024-01-01 10:00:01 ERROR Connection failed", "2024-01-01 10:00:02 WARN Low disk space",
    "2024-01-01 10:00:03 FATAL panic in module", "2024-01-01 10:00:04 INFO Recovered", "2024-01-01 10:00:05 ERROR Timeout waiting",
]
LOGIN = [
    "INFO  Application started", "INFO  Loading config", "ERROR Login failed for user admin", "WARN  Account locked after 3 tries", "INFO  Retry attempt scheduled", "INFO  Processing queue",
    "INFO  Request completed", "ERROR Login failed for user bob", "INFO  Sending notification", "WARN  Account locked after 5 tries", "INFO  Retry attempt scheduled", "INFO  Cleanup started",
]


@pytest.mark.parametrize(("threshold", "want"), [(30, [(2, 0 + 1, 55.0)]), (3, [(1, 0, 5.0), (2, 1, 55.0)]), (120, [])])
@pytest.mark.parametrize("chunk", [1, 2, 100])
def test_time_gaps(spark, threshold, want, chunk):
    got = sequence.time_gaps(lines(spark, GAPS), threshold, chunk).collect()
    assert sorted((r.line_no, r.prev_line, r.gap_seconds) for r in got) == want


def test_gap_preview_is_cut(spark):
    long = lines(spark, ["2024-01-01 10:00:00 a", "2024-01-01 11:00:00 " + "x" * 100])
    assert sequence.time_gaps(long).first().preview == ("2024-01-01 11:00:00 " + "x" * 60) + "..."


def test_scoped_levels(spark):
    count = lambda df: {r.level: r.lines for r in profile.level_counts(df).collect() if r.lines}
    log = lines(spark, SCOPED)
    assert count(log) == {"info": 2, "error": 2, "warning": 1, "fatal": 1}
    assert count(search.scope_range(log, 3, 2)) == {"warning": 1, "fatal": 1}


def test_context_search(spark):
    log = lines(spark, LOGIN)
    run = lambda **k: {r.line_no: (r.score, r.clue_lines, r.complete) for r in proximity.context_search(log, {"m": "Login failed"}, **k).collect()}
    assert run(clues={"c": ("Account locked", 5)}) == {2: (1, "3:c", True), 7: (2, "3:c,9:c", True)}
    assert run(clues={"c": ("Account locked", 1)}) == {2: (1, "3:c", True), 7: (0, "", False)}
    assert run(clues={"c": ("Account locked", None)}, default=1)[7] == (0, "", False)
    assert run(clues={"c": ("Account locked", 5), "d": ("Retry attempt", 5)})[2] == (2, "3:c,4:d", True)
    assert run(clues={}) == {2: (1, "", True), 7: (1, "", True)}
    assert proximity.context_search(log, {"m": "login failed"}, {"c": ("Account locked", 5)}).count() == 0


@pytest.mark.parametrize(
    ("mode", "a", "b", "want"),
    [
        ("nearest", [8, 16, 13], [10, 20], [(8, 10, 2), (13, 10, 3), (16, 20, 4)]), ("nearest", [1], [], []), ("nearest", [5], [5], [(5, 5, 0)]), ("nearest", [100], [1, 2, 3], [(100, 3, 97)]),
        ("nearest", [0], [5, 9], [(0, 5, 5)]), ("nearest", [7], [5, 8], [(7, 8, 1)]), ("nearest", [7], [5, 9], [(7, 9, 2)]), ("after", [8, 25], [10, 20], [(8, 10, 2)]), ("before", [15, 3], [10, 20], [(15, 10, 5)]),
    ],
)
def test_pattern_distance(spark, mode, a, b, want):
    got = proximity.pattern_distance(numbers(spark, a), numbers(spark, b), mode, chunk=4).collect()
    assert sorted((r.a_line, r.b_line, r.distance) for r in got) == want


@pytest.mark.parametrize(("given", "want"), [([100, None, None, 200], [100, 100, 100, 200]), ([None, None, 500, 600], [500, 500, 500, 600]), ([None, None, None], [None] * 3), ([], [])])
def test_carry_forward(spark, given, want):
    rows = spark.createDataFrame([("f", k, v) for k, v in enumerate(given)], "file string, line_no long, ms long")
    for chunk in (1, 2, 100):
        assert [r.out for r in sorted(sequence.carry_forward(rows, "ms", "out", chunk).collect(), key=lambda r: r.line_no)] == want


def test_origin_tags(spark):
    tags = lambda files: sorted(r.origin for r in proximity.origin_tags(spark.createDataFrame([(f,) for f in files], "file string")).collect())
    assert tags(["/a/device.log", "/b/modem.log"]) == ["device.log", "modem.log"]
    assert tags(["/logs/node1/app.log", "/logs/node2/app.log"]) == ["node1/app.log", "node2/app.log"]


def test_spread_of_equal_times(spark):
    rows = spark.createDataFrame([(30, 1000), (10, 1000), (20, 1000), (99, 2000)], "line_no long, ms long")
    got = {r.line_no: r.spread_ms for r in sequence.spread_equal_times(rows, 100).collect()}
    assert {k: round(v) for k, v in got.items()} == {10: 1000, 20: 1283, 30: 1567, 99: 2000}


def test_fields(spark):
    cases = {
        'connecting v=2.1 ok=true name="alpha beta" tags=[a,b]': {"v": "2.1", "ok": "true", "name": "alpha beta", "tags": "[a,b]"},
        "2024-01-01 12:34:56 latency: 230 mode: idle": {"latency": "230", "mode": "idle"},
        '{"level":"error","code":500,"ok":false,"none":null}': {"level": "error", "code": "500", "ok": "false"},
        "v=1 v=2": {"v": "1"},
    }
    got = {r.text: r.m for r in lines(spark, list(cases)).select("text", parse.extract_fields("text").alias("m")).collect()}
    assert got == cases


def test_field_discovery_series_and_types(spark):
    log = lines(spark, ["v=1 mode=idle", "v=2 mode=active", "v=3 mode=active"])
    got = {r.name: (r.type, r.occurrences, r["distinct"]) for r in trend.discover_fields(log).collect()}
    assert got == {"v": ("numeric", 3, 3), "mode": ("string", 3, 2)}
    times = lines(spark, ["2024-01-01 00:00:00 v=10", "2024-01-01 00:00:30 v=20", "2024-01-01 01:00:00 v=100"])
    rows = sorted(trend.series(times, "v", buckets=10).collect(), key=lambda r: r.bucket)
    assert [(r.bucket, r.points, r.high) for r in rows] == [(0, 2, 20.0), (9, 1, 100.0)]


def test_redaction(spark):
    texts = [
        "Connection from 192.168.1.100 accepted", "10.0.0.1 -> 172.16.0.5", "src=10.0.0.1", "dst=10.0.0.1", "2001:0db8:85a3:0000:0000:8a2e:0370:7334 up", "mail alice@example.com now",
        "id 550e8400-e29b-41d4-a716-446655440000", "color=#ff00ff", "plain error text", "key " + "ab" * 20,
    ]
    got = {r.text: r.t for r in lines(spark, texts).select("text", parse.redact_hashed("text").alias("t")).collect()}
    assert "192.168" not in got[texts[0]] and "[IP-" in got[texts[0]]
    assert got[texts[1]].count("[IP-") == 2
    assert got[texts[2]].removeprefix("src=") == got[texts[3]].removeprefix("dst=")
    assert "[IPV6-" in got[texts[4]] and "[EMAIL-" in got[texts[5]] and "[UUID-" in got[texts[6]] and "[KEY-" in got[texts[9]]
    assert got[texts[7]] == texts[7] and got[texts[8]] == texts[8]


def test_grok(spark):
    pattern, names = parse.grok(r"id=%{id:\d+} %{rest}")
    assert names == ["id", "rest"]
    got = lines(spark, ["id=42  some words", "no match"]).select("line_no", *parse.pattern_columns("text", pattern, names)).orderBy("line_no").collect()
    assert [(r.id, r.rest) for r in got] == [("42", "some words"), (None, None)]
    assert parse.grok("%{a b} %{a b}")[1] == ["a_b", "a_b_2"]


def test_times_of_all_forms(spark):
    texts = ["2024-01-02T03:04:05,678901 x", "05.03.2024 10:11:12", "Mar  7 08:09:10 host", "2024-13-45 99:00:00", "none"]
    got = [r.ts for r in lines(spark, texts).select("line_no", parse.parse_ts("text", 2020).alias("ts")).orderBy("line_no").collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5, 678000), dt.datetime(2024, 3, 5, 10, 11, 12), dt.datetime(2020, 3, 7, 8, 9, 10), None, None]


def test_severity_and_next_problem(spark):
    log = lines(spark, SCOPED)
    assert [r.r for r in log.select("line_no", parse.severity_rank("text").alias("r")).orderBy("line_no").collect()] == [0, 2, 1, 3, 0, 2]
    marks = numbers(spark, [0, 1, 5])
    ahead = {r.line_no: r.problem_line for r in search.next_problem(log, marks, chunk=3).collect()}
    back = {r.line_no: r.problem_line for r in search.next_problem(log, marks, forward=False, chunk=3).collect()}
    assert ahead == {0: 1, 1: 2, 5: None} and back == {0: None, 1: None, 5: 3}


def test_crash_recipe_names_the_last_line_first(spark):
    texts = ["ok"] * 81
    texts[41], texts[9], texts[80] = "FATAL a", "unhandled b", "FATAL c"
    rows = sorted((r.line_no, r.title) for r in recipes.crash(lines(spark, texts)).collect())
    assert rows == [(9, "unhandled"), (41, "fatal"), (80, "final crash line")]


@pytest.mark.parametrize(
    ("texts", "want"),
    [(["INFO fine"], "clean"), (SCOPED, "crash"), (["2024-01-01 10:00:00 INFO a"] + ["ERROR b"] * 9, "error-storm"), (GAPS, "stall"), (["INFO a", "WARN b"] + ["INFO"] * 30, "warnings")],
)
def test_conclusion(spark, texts, want):
    assert profile.conclusion_verdict(lines(spark, texts)).first().verdict == want


def test_filters(spark):
    log = lines(spark, SCOPED)
    keep = lambda df: sorted(r.line_no for r in df.collect())
    assert keep(search.filter_basic(log, ["error"])) == [1, 5]
    assert keep(search.filter_basic(log, ["fatal"], context=1)) == [2, 3, 4]
    assert keep(search.filter_basic(log, ["fatal"], exclude=["Recovered"], context=1)) == [2, 3]
    assert keep(search.filter_basic(log, include=["(bad", "low DISK"])) == [2]
    groups = [{"operator": "OR", "rules": [("level", "info"), ("contains", "panic")]}, {"operator": "AND", "rules": [("not_regex", "Recov.*")]}]
    assert keep(search.filter_advanced(log, groups)) == [0, 3]
    assert keep(search.filter_advanced(log, [{"operator": "AND", "rules": []}])) == list(range(6))


def test_json_lines(spark):
    texts = ['{"msg":"hi","level":"warn","time":"t0","n":1,"o":{"a":2}}', "{bad", "", '{"event":"e"}']
    got = [r.text for r in readers.json_lines(lines(spark, texts)).orderBy("line_no").collect()]
    assert got == ['t0 WARN hi n=1 o={"a":2}', "{bad", "", "e"]
