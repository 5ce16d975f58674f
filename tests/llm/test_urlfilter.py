from __future__ import annotations

import datetime as dt
import random
from urllib.parse import urlsplit

from tracewell.llm import urlfilter

DAY = dt.date(2024, 1, 1)
ENTRY = "list string, kind string, value string, action string, day date"


def brute(url, day, entries) -> tuple[int, str | None]:
    if url is None or day is None or "://" not in url:
        return 0, None
    parts = urlsplit(url.lower())
    host, path = parts.hostname or "", [x for x in parts.path.split("/") if x]
    labels = host.split(".")
    keys = {("host", host)} | {("domain", ".".join(labels[i:])) for i in range(len(labels))}
    keys |= {("prefix", "/".join([host, *path[:i]])) for i in range(1, min(3, len(path)) + 1)}
    active = []
    for rule in {(e[0], e[1], e[2]) for e in entries if e[2] is not None and (e[1], e[2].lower()) in keys}:
        past = sorted((e[4], 0 if e[3] == "add" else 1) for e in entries if e[:3] == rule and e[4] is not None and e[4] <= day)
        if past and past[-1][1] == 0:
            active.append("/".join([rule[0], rule[1], rule[2].lower()]))
    return len(active), min(active, default=None)


def test_captures_meet_the_entries_of_their_day(spark):
    rng = random.Random(1)
    hosts = ["a.example.org", "b.a.example.org", "example.org", "x.net"]
    entries = [
        (rng.choice("pq"), kind, value, rng.choice(["add", "add", "remove"]), DAY + dt.timedelta(rng.randrange(30)))
        for kind, value in [("host", h) for h in hosts] + [("domain", h) for h in hosts] + [("prefix", h + "/en") for h in hosts] + [("prefix", "x.net/en/b")]
        for _ in range(rng.randrange(4))
    ]
    entries += entries[:3] + [("p", "host", None, "add", DAY), ("p", "host", "x.net", "add", None)]
    urls = [f"http://{h.upper() if k % 2 else h}/{p}" for h in hosts for k, p in enumerate(["", "en", "en/b/c/d?q=1#z", "/en//b"])]
    urls += ["https://user:pw@x.net:8080/en", "not a url", "", None, "ftp://"]
    rows = [(k, u, DAY + dt.timedelta(d) if d >= 0 else None, "list") for k, (u, d) in enumerate((u, d) for u in urls for d in (-1, 0, 7, 15, 29, 60))]
    rows += rows[:5]
    captures = spark.createDataFrame(rows, "page_id long, url string, fetched_on date, n_active string").repartition(4)
    got = urlfilter.judge(captures, spark.createDataFrame(entries, ENTRY).repartition(3)).collect()
    assert len(got) == len(rows)
    for r in got:
        n, rule = brute(r.url, r.fetched_on, entries)
        assert (r.n_active, r.first_rule, r.blocked) == (n, rule, n > 0), r


def test_no_entries_and_no_captures(spark):
    captures = spark.createDataFrame([(1, "http://x.net/", DAY)], "page_id long, url string, fetched_on date")
    none = spark.createDataFrame([], ENTRY)
    assert [r.blocked for r in urlfilter.judge(captures, none).collect()] == [False]
    assert urlfilter.judge(captures.limit(0), none).count() == 0
