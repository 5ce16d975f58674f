"""Verbs take in whole logs where no limit is asked for."""

from __future__ import annotations

from tracewell.operators import profile, recipes, search
from tracewell.sources import readers

SCHEMA = "file string, line_no long, text string"


def test_density_covers_all_days(spark):
    times = ["2024-01-01 10:00:00", "2024-01-01 10:02:00", "2024-01-03 10:01:00", "2024-01-03 10:01:30"]
    lines = spark.createDataFrame([("a", k, t + " INFO x") for k, t in enumerate(times)], SCHEMA)
    got = {r.minute: r.lines for r in profile.minute_density(lines).collect()}
    assert got == dict.fromkeys(range(2882), 0) | {0: 1, 2: 1, 2881: 2}
    assert {r.minute for r in profile.minute_density(lines, most=3).collect()} == {0, 1, 2}
    assert sum(x.lines for x in profile.fingerprint(lines).first().density) == 4


def test_a_burst_on_a_later_day_is_found(spark):
    even = [f"2024-01-0{d} 10:{m:02}:00 INFO x" for d in (1, 2, 3) for m in range(60)]
    burst = even + ["2024-01-03 11:00:00 INFO x"] * 100
    runs = [spark.createDataFrame([("a", k, t) for k, t in enumerate(r)], SCHEMA) for r in (burst, even)]
    assert [r.category for r in profile.compare_profiles(*runs).collect()] == ["density"]


def test_rates_signatures_and_domains_are_of_all_lines(spark):
    texts = ["k=1, x"] * 700 + ["panic | HardFault | watchdog"] * 700
    lines = spark.createDataFrame([("a.log", k, t) for k, t in enumerate(texts)], SCHEMA)
    r = search.pattern_match_rate(lines, "k=").first()
    assert (r.matched, r.scanned, r.rate) == (700, 1400, 0.5)
    assert search.pattern_match_rate(lines, "k=", head=400).first().scanned == 400
    r = recipes.check_requirements(lines, "k=", "panic", "*.log", least=0.5).first()
    assert (r.match_rate, r.columns, r.signature, r.named, r.blocked) == (0.5, True, True, True, False)
    r = recipes.detect_domain(lines).first()
    assert (r.domain, r.hits) == ("embedded", 1400)
    assert recipes.detect_domain(lines, head=600).first().domain == "generic"
    usual = {r.delimiter: r.usual for r in readers.delimiter_scores(lines).collect()}
    assert usual["pipe"] == 2 and usual["comma"] == 0  # 700 against 699 lines


def test_hits_are_all_there_with_whole_text(spark):
    tail = "x" * 600
    texts = [f"INFO panic connection reset mode={k % 2} {tail}" for k in range(150)]
    lines = spark.createDataFrame([(f"f{f:02}", k, t) for f in range(8) for k, t in enumerate(texts)], SCHEMA)
    found = search.search_folder(lines, "panic").collect()
    assert len(found) == 1200 and all(r.text.endswith(tail) for r in found)
    assert len(search.search_folder(lines, "panic", per_file=3, total=20).collect()) == 20
    assert all(r.text.endswith(tail) for r in profile.crash_sites(lines).collect())
    assert recipes.connection_drops(lines).count() == 1200
    assert recipes.flips(lines, "mode").count() == 8 * 149
    assert recipes.flips(lines, "mode", most=10).count() == 80
    assert recipes.ui_state(lines, ["mode"]).count() == 8 * (150 + 149)
