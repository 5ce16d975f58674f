"""Personal data and disclosing terms against the task's patterns and plain counting."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import pytest

from tracewell.llm import disclosure, oracles, queries

SCHEMA = "doc_id long, text string, row int, kind string, spans string, term string, sanitised string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LETTERS = r"[^\W\d_]{4,}"


def luhn(digits: str) -> bool:
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def good(kind: str, match: str) -> bool:
    digits = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in match.split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def brute(docs: list[tuple], reach: int = 64, contexts: int = 2, general: float = 0.5) -> list[tuple]:
    base, near, holds = [], defaultdict(set), defaultdict(set)
    seen = defaultdict(set)
    places = defaultdict(list)
    for r, (_, text, *_) in enumerate(docs):
        text, found = text or "", []
        for k, (kind, pattern) in enumerate(PLAIN.items()):
            hits = list(re.finditer(pattern, text))
            for i, m in enumerate(hits):
                if not good(kind, m[0]):
                    continue
                found.append((k, m.start(), m.end()))
                value = (kind, m[0].lower() if k < 2 else re.sub("[^0-9]", "", m[0]))
                holds[value].add(r)
                lo, hi = hits[i - 1].end() if i else 0, hits[i + 1].start() if i + 1 < len(hits) else len(text)
                before, after = (max(lo, m.start() - reach), m.start()), (m.end(), min(hi, m.end() + reach))
                for a, b in (before, after):
                    for w in re.finditer(LETTERS, text[a:b]):
                        if (w.start() == 0 and a > lo and a == before[0]) or (w.end() == b - a and b < hi and b == after[1]):
                            continue
                        near[value, w[0].lower()].add(r)
                        seen[value, w[0].lower()].add((text[slice(*before)], text[slice(*after)]))
                        places[value, w[0].lower()].append((r, a + w.start(), a + w.end()))
        base.append(found)
    n = len(docs)
    with_term = defaultdict(set)
    for r, (_, text, *_) in enumerate(docs):
        for w in re.findall(LETTERS, text or ""):
            with_term[w.lower()].add(r)
    marked = defaultdict(set)
    for (value, term), rows in near.items():
        n_value = len(holds[value])
        if len(seen[value, term]) < contexts or n_value == n:
            continue
        if math.log(len(rows) * n / (n_value * len(with_term[term]))) / math.log(n / n_value) >= general - 1e-9:
            for r, a, b in places[value, term]:
                if not any(s < b and e > a for _, s, e in base[r]):
                    marked[r].add((4, a, b))
    out = []
    for r, (key, *_) in enumerate(docs):
        told = lambda spans: ",".join(f"{disclosure.KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))
        counts = [sum(s[0] == k for s in base[r]) for k in range(4)]
        out.append((key, *counts, hashlib.sha256(told(base[r]).encode()).hexdigest(), told([*base[r], *marked[r]])))
    return out


def documents() -> list[tuple]:
    rng = random.Random(13)
    words = [f"{a}{b}{c}" for a in ("lan", "mör", "tis", "ve") for b in ("do", "ré", "ka") for c in ("n", "st", "la")]
    rows = []
    for k in range(160):
        text = " ".join(rng.choices(words, k=rng.randrange(5, 60)))
        if k % 8 == 0:
            text += f" Ms Zanzibari wrote from ana.{k % 3}@mail.example.org on {rng.choice(words)} "
        if k % 10 == 1:
            text = f"{rng.choice(words)} router Quillon at 10.20.30.{k % 4} {rng.choice(words)} " + text
        if k % 9 == 2:
            text += " card 4556 7375 8689 9855 of Wexford, tel. +49 (30) 1234-567 " + rng.choice(words)
        rows.append((k, text + " end"))
    odd = [
        "a@b.c_d@e.f x@y x2@z.com b.@c.d a@b@c.d Ünicode.ä.b@c.de", "1.2.3.4.5.6.7.8 999.1.1.1 00255.1.1.1 256.1.1.1 1.2.3",
        "4556737586899855, 4556737586899856, 1-2-3, 12345678901234567890", "+1 + 2 +12345678 +123456789 +1 (2) 3.4-5 678 90 +1234567890123456", "", "   ", None, "é@é.é", "9" * 50_000 + " " + "a" * 50_000 + "@" + "." * 50_000, "+1" + " " * 50_000,
    ]
    rows += [(200 + k, text) for k, text in enumerate(odd)]
    return [*rows, rows[0], rows[0], (None, "x ana.0@mail.example.org y"), (None, None)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory) -> str:
    root = tmp_path_factory.mktemp("pii")
    spark.createDataFrame([(*r, 1, "k", "s", "t", "z") for r in documents()], SCHEMA).repartition(4).write.parquet(f"{root}/documents.parquet")
    return str(root)


def ordered(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=str)


def test_query_equals_plain_counting_and_its_sql(spark, table):
    found = queries.op13_personal(spark, table)
    assert found.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    got, want = ordered(found.collect()), ordered(brute(documents()))
    assert len(got) == len(want) and [(a, b) for a, b in zip(got, want, strict=True) if a != b] == []
    assert sum("term:" in r[6] for r in got) > 20
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{table}/documents.parquet/*.parquet'")
    assert ordered(db.sql(oracles.op13()).fetchall()) == got


def test_no_python_on_the_executors(spark, table):
    plan = queries.op13_personal(spark, table)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sanitised_texts(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    out = disclosure.sanitise(docs)
    assert sorted(out.columns) == sorted(docs.columns)
    rows = {r.doc_id: (r.text, r.sanitised) for r in out.where("doc_id is not null").collect()}
    assert all("zanzibari" not in s.lower() and "@mail" not in s and "[email]" in s for t, s in rows.values() if t and "Zanzibari" in t)
    assert rows[206] == (None, None) and rows[204] == ("", "") and rows[3][1] == rows[3][0]
    assert rows[202][1].startswith("[card], 4556737586899856, ")


def test_terms_are_removed_or_made_general_by_their_share(spark):
    rows = [(k, f"note {k} from Bordeaux{k % 7} Alpha by key{k}@one.org") for k in range(40)]
    rows += [(100 + k, f"{'n' * k} Secretname and Common{k % 2} to boss@one.org") for k in range(5)] + [(200 + k, "Common0 Common1 Alpha") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.sanitised for r in disclosure.sanitise(df).collect()}
    assert all("Secretname" not in out[100 + k] and "[email]" in out[100 + k] for k in range(5))
    assert all(out[k] == f"note {k} from Bordeaux{k % 7} Alpha by [email]" for k in range(40)) and out[200] == "Common0 Common1 Alpha"


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert disclosure.digests(empty).collect() == [] and disclosure.sanitise(empty).collect() == []
