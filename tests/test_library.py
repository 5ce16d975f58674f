"""Pattern libraries against trying every pattern on every line."""

from __future__ import annotations

import random
import re

from tests.test_extend import lines
from tracewell.operators import library, search


def test_literals_that_a_match_needs():
    want = {
        "user_id=12": ["user_id=12"], "user_id=(?:1|22) x": ["user_id="], "(alpha|Beta+)": ["alpha", "beta"], "ab+cdef": ["cdef"], "abc?": None, "a.b.c": None, r"\d+": None, "(?i)ABC": ["abc"],
        r"foo\.bar\b": ["foo.bar"], "[abc]def[^]x]gh": ["def"], "x{2,3}yyy": ["yyy"], "(abc)*": None, "(abc){0,2}de": None, "ab|cde": None, "": None, "(?=abc)d": None, "(?<name>abcd)e": ["abcde"],
        r"\Qa.b\E": None, "(?x) a b c": None, "abc(de(fg|hi)+)?": ["abc"], "a(bc)d": ["abcd"], "abc++d": ["ab+"[:2] + "c"], r"[\]]abc": ["abc"], "(?:abc": None, "abc)": None, "((((abcd))))": ["abcd"], "(?:ab|cd)+efg": ["efg"],
    }
    for pattern, literals in want.items():
        assert library.needed_literals(pattern) == literals, pattern


def test_literals_hold_in_every_match():
    rng = random.Random(6)
    parts = ["ab", "cd", "E", "f", "[gh]", "i?", "j+", "(kl|mn)", "(?:op)?", ".", "q{2}", "(rs)+", "|", "x", "yz", "\\d", "\\."]
    texts = ["".join(rng.choices("ab cd E f g h i j kl mn op qq rs x yz 1 .".split(), k=40)) for _ in range(200)]
    tried = 0
    for _ in range(3000):
        pattern = "".join(rng.choices(parts, k=rng.randrange(1, 7)))
        needed = library.needed_literals(pattern)
        for text in rng.sample(texts, 20) if needed else ():
            m = re.search(pattern, text)
            if m:
                tried += 1
                assert any(x in m[0].lower() for x in needed), (pattern, m[0])
    assert tried > 20


def test_alternatives_are_looked_up_with_what_stands_around_them(spark):
    """A table of patterns that share a text before their alternatives is not tried on all lines that hold that text."""
    want = {
        "user_id=(?:1|22) x": ["user_id=1 x", "user_id=22 x"], "(?i)ID=(5|67)": ["id=5", "id=67"], "abc(?:|d)e": ["abcde", "abce"], "a(?:b|c)?def": ["def"], "(?:foo|bar)+x": ["bar", "foo"],
        "k=((a|b)c|de) ": ["k=ac ", "k=bc ", "k=de "], "(?:b|c){2}def": ["def"], "(?=ab|cd)efg": ["efg"],
    }
    table = spark.createDataFrame([(p, p) for p in want], "pattern_id string, pattern string")
    assert {r.pattern_id: r.needed for r in library.rules(table).collect()} == want
    many = "user_id=" + "(?:0|1)" * 6
    assert len(library.needed_literals(many, spread=library.SPREAD)) <= library.SPREAD
    rng = random.Random(7)
    parts = ["ab", "c", "(?:d|ef)", "(g|)", "(?:h|i)?", "(?:j|kl)+", "(mn|(?:o|p)q)", ".", "|", "(?:r|st){2}", "\\."]
    texts = ["".join(rng.choices("ab c d ef g h i j kl mn oq pq r st .".replace(" ", ",").split(","), k=40)) for _ in range(200)]
    tried = 0
    for _ in range(3000):
        pattern = "".join(rng.choices(parts, k=rng.randrange(1, 7)))
        needed = library.needed_literals(pattern, spread=8)
        for text in rng.sample(texts, 20) if needed else ():
            m = re.search(pattern, text)
            if m:
                tried += 1
                assert any(x in m[0] for x in needed), (pattern, m[0])
    assert tried > 20


def test_a_library_equals_each_pattern_on_each_line(spark, monkeypatch):
    monkeypatch.setattr(library, "BLOCK", 3)
    rng = random.Random(5)
    log = lines(spark, [" ".join(rng.choices(["Error", "error=12", "user_id=7", "user_id=70", "K", "ſ", "É", "", "timeout", "x" * 40], k=5)) for _ in range(150)] + ["", "é" * 3000 + "needle"])
    patterns = ["user_id=7", r"user_id=7\b", "Error|timeout", "(?i)ERROR", r"\d\d", "x{30}", "^$", "(", "[", "", None, "É", "needle$", "user_id=(?:7|70) error", "K", "[éÉ]{3}", "ime"]
    table = spark.createDataFrame([*[(f"p{k}", p) for k, p in enumerate(patterns)], ("p0", "timeout"), ("p0", "user_id=7")], "pattern_id string, pattern string").repartition(3)
    for case in (True, False):
        got = sorted((r.file, r.line_no, r.pattern_id) for r in library.search_library(log, table, case).collect())
        given = {f"p{k}": p for k, p in enumerate(patterns) if p} | {"more": "timeout"}
        want = {(r.file, r.line_no, r.pattern_id.replace("more", "p0")) for r in search.search_batch(log, given, case).collect()}
        assert got == sorted(want) and len(got) > 200
    audit = {r.pattern_id: (r.valid, r.matched) for r in library.library_audit(log, table).collect()}
    assert audit["p7"] == (False, 0) and audit["p9"] == (False, 0) and audit["p10"] == (False, 0) and audit["p12"] == (True, 1) and len(audit) == len(patterns)


def test_no_lines_and_no_patterns(spark):
    log = lines(spark, ["a line"])
    none = spark.createDataFrame([], "pattern_id string, pattern string")
    assert library.search_library(log, none).collect() == [] and library.search_library(log.limit(0), spark.createDataFrame([("a", "line")], none.schema)).collect() == []


def test_invalid_patterns_match_nothing(spark):
    log = lines(spark, ["a b", "c d"])
    assert search.filter_column(log, 0, "(", "regex").collect() == [] and search.filter_column(log, 0, "^a", "regex").count() == 1
    assert [r.matched for r in search.pattern_match_rate(log, "[").collect()] == [0]
