"""Exact medians and window counts without pairs, against plain Python."""

from __future__ import annotations

import datetime
import random
import statistics

import pytest

from tests.test_extend import lines
from tracewell.operators import proximity
from tracewell.operators.quantiles import middles


@pytest.mark.parametrize("bins", [2, 7, 1024])
def test_middles_of_groups(spark, bins):
    rng = random.Random(bins)
    groups = {"a": [5], "b": [1, 2], "c": [7] * 40, "d": [rng.randrange(-(10**6), 10**6) for _ in range(401)], "e": [rng.randrange(3) for _ in range(50)], "f": [-(1 << 39), 1 << 39, 0, 3], "g": []}
    rows = [(g, v) for g, values in groups.items() for v in [*values, None]]
    df = spark.createDataFrame(rows, "g string, v long").repartition(5)
    got = {r.g: (r.n, (r.low + r.high) / 2) for r in middles(df, ["g"], "v", bins).collect()}
    assert got == {g: (len(v), statistics.median(v)) for g, v in groups.items() if v}
    if bins == 7:
        whole = [v for values in groups.values() for v in values]
        assert [(r.n, (r.low + r.high) / 2) for r in middles(df, [], "v", bins).collect()] == [(len(whole), statistics.median(whole))]


@pytest.mark.parametrize("chunk_ms", [1, 700, 3_600_000])
def test_clues_within_a_time(spark, chunk_ms):
    rng = random.Random(chunk_ms)
    start, rows = datetime.datetime(2024, 1, 1), []
    for n in range(160):
        ms = rng.choice([rng.randrange(20_000), 5_000, 5_001])
        rows.append((ms, rng.choice(["must", "clue", "must clue", "other"])))
    texts = [f"{(start + datetime.timedelta(milliseconds=ms)).isoformat(' ', 'milliseconds')} {what}" for ms, what in rows] + ["must clue without a time"]
    got = {r.line_no: (r.score, r.nearest_ms) for r in proximity.context_search_time(lines(spark, texts), "must", "clue", 600, chunk_ms).collect()}
    want = {}
    for n, (ms, what) in enumerate(rows):
        near = [abs(ms - m) for k, (m, w) in enumerate(rows) if k != n and "clue" in w and abs(ms - m) <= 600]
        if "must" in what and near:
            want[n] = (len(near), min(near))
    assert got == want and len(want) > 40
