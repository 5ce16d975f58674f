"""Registered queries on small tables that are dealt or dated otherwise than the driver's."""

from __future__ import annotations

import datetime

from tracewell.plans import registry


def test_the_file_that_stalls_does_so_however_close_its_lines_are(spark, tmp_path):
    """A line each second for ten minutes, each fifth a purchase; the other verdicts stay too."""
    kinds = ["purchase", "error", "signup", "view", "click"]
    rows = [(k, datetime.datetime(2024, 1, 1, 10, k // 60, k % 60), k, kinds[k % 5], 1.0, f'{{"k": {k // 5 % 100}}}') for k in range(600)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.file: (r.verdict, r.errors, r.warnings) for r in registry.QUERIES["a34_verdict"](spark, str(tmp_path)).collect()}
    crashed = sum(k % 100 % 10 < 2 for k in range(120))
    assert got == {"crashed": ("crash", crashed, 0), "storming": ("error-storm", 120 - crashed, 0), "stalled": ("stall", 0, 0), "warned": ("warnings", 0, 120), "clean": ("clean", 0, 0)}
