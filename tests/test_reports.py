"""Columns by role and the reports, on small literal logs."""

from __future__ import annotations

from tracewell.operators import columns, investigate, proximity, recipes, search

HEAD = "Timestamp,Level,Component,Message"
ROWS = [
    "2024-01-01 10:00:00,Error,net.tcp,all fine",
    '2024-01-01 10:00:05,info,db,"a FATAL, quoted word"',
    "2024-01-01 10:01:00,severe,net.udp,link lost",
    "2024-01-01 10:01:02,notice,,panic in kernel",
]


def log(spark, texts, file="t.csv"):
    return spark.createDataFrame([(file, k, t) for k, t in enumerate(texts)], "file string, line_no long, text string").repartition(3)


def test_columns_have_names_roles_types_and_samples(spark):
    got = {r.name: r for r in columns.analyze_columns(log(spark, [HEAD, *ROWS]), samples=2).collect()}
    assert [got[n].role for n in HEAD.split(",")] == ["timestamp", "level", "channel", "message"]
    assert got["Level"].samples == "Error|info" and got["Component"].values == 3 and got["Message"].type == "string"
    bare = {r.name: r.role for r in columns.analyze_columns(log(spark, ROWS)).collect()}
    assert bare == {f"column{k}": "other" for k in range(1, 5)}
    assert columns.analyze_columns(log(spark, [HEAD]).limit(0)).count() == 0


def test_a_table_is_typed_by_what_all_its_cells_are(spark):
    texts = ["time,level,flag,level", "1,x,true,7", "2.5,,FALSE,8", "3,z,,9"]
    got = columns.column_table(log(spark, texts), ",").orderBy("line_no")
    assert got.dtypes[2:] == [("time", "double"), ("level", "string"), ("flag", "boolean"), ("level_4", "double")]
    assert [tuple(r)[2:] for r in got.collect()] == [(1.0, "x", True, 7.0), (2.5, None, False, 8.0), (3.0, "z", None, 9.0)]


def test_the_analysis_reads_cells_by_their_role(spark):
    lines = log(spark, [HEAD, *ROWS])
    rows = [tuple(r) for r in columns.by_role(lines).orderBy("line_no").select("line_no", "message", "level_cell", "component_cell").collect()]
    assert rows == [(1, "all fine", "Error", "net.tcp"), (2, "a FATAL, quoted word", "info", "db"), (3, "link lost", "severe", "net.udp"), (4, "panic in kernel", "notice", "")]
    got = {(r.section, r["item"]): (r.n, r.line_no) for r in investigate.analyze(columns.by_role(lines)).collect()}
    assert got["level", "error"] == (2, 1) and got["level", "warning"] == (1, 4) and got["level", "info"] == (1, 2)
    assert got["crash", "fatal"] == (1, 2) and got["crash", "panic"] == (1, 4) and got["failing", "net"] == (2, 1)


def test_reports_on_a_component_and_a_span(spark):
    texts = [f"2024-01-01 10:{k:02}:00 {'ERROR' if k % 10 == 3 else 'INFO'} [net] n={k}" for k in range(60)]
    texts[30] = "no time panic here"
    lines = log(spark, texts, "t.log")
    got = [(r.section, r.place, r["item"], r.n, r.line_no) for r in investigate.component(lines, "NET", samples=2, sites=3, around=1).collect()]
    assert ("level", 1, "error", 6, 3) in got and ("level", 1, "info", 53, 0) in got and ("top failer", 1, "net", 6, 3) in got
    assert sorted(x[4] for x in got if x[0] == "error site") == [3, 23, 43] and all(x[3] == 3 for x in got if x[0] == "error site")
    got = [(r.section, r.place, r.line_no) for r in investigate.timerange(lines, "2024-01-01 10:20:00", "2024-01-01 10:40:30", edge=2, gaps=1).collect()]
    assert {x for x in got if x[0] == "first lines"} == {("first lines", 1, 20), ("first lines", 2, 21)}
    assert {x for x in got if x[0] == "last lines"} == {("last lines", 1, 40), ("last lines", 2, 39)}
    assert ("crash", 1, 30) in got and ("silence", 1, 31) in got


def test_evidence_requirements_and_crash_markers(spark):
    lines = log(spark, ["INFO [db] ok", "ERROR [db] a", "WARN [db] b", "ERROR [db] panic", "ERROR [net] c"], "t.log")
    findings = spark.createDataFrame([("new-crash", "panic"), ("level-shift", "warning"), ("error-rate", "db"), ("new-crash", "oom")], "category string, subject string")
    got = sorted((r.subject, r.line_no) for r in proximity.evidence(findings, lines, 2).collect())
    assert got == [("db", 1), ("db", 2), ("panic", 3), ("warning", 2)]
    r = recipes.check_requirements(lines, r"\[\w+\]", "nothing like it", "T.*").first()
    assert (r.columns, r.signature, r.named, r.format, r.blocked) == (True, False, True, None, True)
    r = recipes.check_requirements(lines, r"\[\w+\]", "(", None, "json").first()
    assert (r.signature, r.unverified, r.format, r.blocked) == (None, 1, False, True)
    assert not recipes.check_requirements(lines).first().blocked
    web = log(spark, ["GET /x 200", "pod OOMKilled", "GET /y 502 "], "w.log")
    assert sorted((r.line_no, r.title) for r in recipes.crash(web, "web").collect()) == [(1, "crash marker"), (2, "crash marker")]


def test_audit_and_batches_with_options(spark):
    lines = log(spark, ["alpha beta", "Alpha", "gamma", "a.b"])
    patterns = {"plain": {"pattern": "a.b"}, "fold": {"pattern": "ALPHA", "case": False}, "not": {"pattern": "alpha", "case": False, "invert": True}, "wild": {"pattern": "g?mma", "wildcard": True}, "bad": "(", "slow": "(a+)+$"}
    got = {r.pattern_id: r for r in search.pattern_audit(lines, patterns).collect()}
    assert {k: (r.valid, r.matched) for k, r in got.items()} == {"plain": (True, 1), "fold": (True, 2), "not": (True, 2), "wild": (True, 1), "bad": (False, 0), "slow": (True, 3)}
    assert got["bad"].warning == "invalid" and got["slow"].warning == "nested quantifier"


def test_baselines_of_one_time_and_signals_of_no_field(spark, tmp_path):
    from tests.test_extend import lines
    from tracewell.operators import trend
    from tracewell.sources import sinks

    path = str(tmp_path / "base")
    for total in (1, 2):
        sinks.save_baseline(spark.createDataFrame([(total,)], "total long"), path, "run", "2024-01-01 00:00:00")
    stored = spark.read.parquet(path)
    picked = {tuple(r) for _ in range(3) for r in sinks.list_baselines(stored.repartition(3)).select("total").collect()}
    assert len(picked) == 1
    sinks.delete_baseline(spark, path, "run", "2024-01-01 00:00:00")
    assert sinks.list_baselines(spark.read.parquet(path)).count() == 0
    assert trend.signals(lines(spark, ["v=1"]), []).collect() == []
