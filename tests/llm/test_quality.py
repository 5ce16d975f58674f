from __future__ import annotations

import random

import numpy as np

from tracewell.llm import quality

SMALL = quality.Params(buckets=1 << 12, rows_per_class=60)
SCHEMA = "doc_id long, text string, quality int"


def rows(n: int, seed: int = 0) -> list[tuple]:
    rng, out = random.Random(seed), []
    for k in range(n):
        words = ["".join(rng.choices("aeioutnrs", k=rng.randrange(2, 7))) for _ in range(rng.randrange(5, 60))]
        good = rng.random() < 0.7
        if not good:
            words = rng.choice([[w.upper() + "!!" for w in words], [w for w in words for _ in range(9)], [w + "%%%" for w in words]])
        out.append((k, " ".join(words), int(good)))
    return out


def test_held_out_accuracy(spark):
    model = quality.fit(spark.createDataFrame(rows(400), SCHEMA).repartition(4), "doc_id", "text", "quality", SMALL)
    test = rows(200, 1)
    got = {r.doc_id: r.score for r in quality.score(spark.createDataFrame(test, SCHEMA), model, also=("doc_id",)).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[k] >= 0.3) == label for k, _, label in test]) > 0.95


def test_scores_are_the_average_of_the_features(spark):
    model = quality.fit(spark.createDataFrame(rows(100), SCHEMA), "doc_id", "text", "quality", SMALL)
    texts = [t for _, t, _ in rows(20, 2)] + ["one", "a a a", " x\ty "]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], SCHEMA).coalesce(1)
    for r in quality.score(df, model, also=("doc_id",)).collect():
        ids, times = quality.bag(texts[r.doc_id].encode(), SMALL)
        logit = model.bias + (model.weight[ids].astype(float) * times).sum() / times.sum()
        assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-6


def test_empty_texts_one_class_no_labels_and_no_rows(spark):
    data = spark.createDataFrame(rows(60), SCHEMA)
    model = quality.fit(data, "doc_id", "text", "quality", SMALL)
    odd = spark.createDataFrame([(1, None, None), (2, "", None), (3, " \n", None)], SCHEMA)
    assert len({r.score for r in quality.score(odd, model).collect()}) == 1
    one = quality.fit(data.where("quality = 1"), "doc_id", "text", "quality", SMALL)
    assert all(r.score > 0.9 for r in quality.score(odd, one).collect())
    none = quality.fit(odd, "doc_id", "text", "quality", SMALL)
    assert {r.score for r in quality.score(odd, none).collect()} == {0.5}
    assert quality.score(odd.limit(0), model).count() == 0
