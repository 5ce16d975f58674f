"""Arrivals of many files: each is one micro-batch, written by several tasks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tracewell.streaming import live, run


@pytest.mark.parametrize("rows_a_file", [1, 3, 20, 250_000])
def test_an_arrival_of_many_files_is_one_micro_batch(spark, monkeypatch, rows_a_file):
    """Also where times that repeat leave arrivals with fewer rows than files."""
    monkeypatch.setattr(run, "ROWS_A_FILE", rows_a_file)
    rng = random.Random(8)
    at = sorted([rng.randrange(1000) for _ in range(60)] + [500] * 40)
    rows = [(f"h{rng.randrange(2)}", f"mode={rng.choice('ab')}{k:03}", 1_700_000_000_000 + 1000 * t) for k, t in enumerate(at)]
    table = spark.createDataFrame(rows, "source string, text string, at long").withColumn("ts", F.timestamp_millis("at")).withColumn("at", F.col("at").cast("double"))
    batches = []
    look = lambda batch, number: batches.append([(r.source, r.text, int(r.at)) for r in batch.collect()])
    stream = run.arrive(table.repartition(3), "at", 5, "rows")
    stream.writeStream.foreachBatch(look).option("checkpointLocation", run.scratch(spark, "look")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(sum(batches, [])) == sorted(rows)
    assert all(max(r[2] for r in a) < min(r[2] for r in b) for a, b in zip(batches, batches[1:], strict=False)), [len(b) for b in batches]
    found = run.detect(run.arrive(table, "at", 5, "rows").drop("at"), live.transition_detector("mode"), "flips").collect()
    want, last = [], {}
    for source, text, ms in sorted(rows, key=lambda r: (r[2], r[1])):
        value = text[5:]
        if source in last:
            want.append((source, last[source], value))
        last[source] = value
    assert sorted((r.source, r.from_value, r.to_value) for r in found) == sorted(want)


def test_an_arrival_is_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(run, "ROWS_A_FILE", 10)
    sizes = []
    look = lambda batch, number: sizes.append(batch.select(F.input_file_name().alias("f")).groupBy("f").count().count())
    stream = run.arrive(spark.range(200).withColumn("at", F.col("id").cast("double")), "at", 2, "ids")
    stream.writeStream.foreachBatch(look).option("checkpointLocation", run.scratch(spark, "look")).trigger(availableNow=True).start().awaitTermination()
    assert sizes == [10, 10]


def test_what_a_detector_reads_of_a_batch_is_worked_out_once(spark):
    """Fields are dear to find, and a micro-batch is scanned several times."""
    seen = spark.sparkContext.accumulator(0)

    def tell(text):
        seen.add(1)
        return text[-1]

    told = F.udf(tell, "string")

    def detect(rows, carry):
        known = rows if "_value" in rows.columns else detect.facts(rows)
        return known.groupBy("_value").count(), known.select(F.max("_value").alias("v"))

    detect.facts = lambda rows: rows.select(told("text").alias("_value"))
    rows = spark.createDataFrame([(f"x{k % 3}", float(k)) for k in range(40)], "text string, at double")
    found = run.detect(run.arrive(rows, "at", 2, "rows"), detect, "found").groupBy("_value").sum("count").collect()
    assert {r[0]: r[1] for r in found} == {"0": 14, "1": 13, "2": 13} and seen.value == 40
    assert [c for c in live.transition_detector("mode").facts(spark.createDataFrame([], "source string, text string, ts timestamp")).columns] == ["source", "ms", "text", "_value"]
