from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tracewell.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, mix_topic string"


def rows(n: int) -> list[tuple]:
    """Documents of common words and of a few words of one of four topics, a fifth of none."""
    rng = random.Random(1)
    subjects = [[f"{a}{b}{c}word" for a in "bdfg" for b in vowels for c in "klmnp"] for vowels in ("ae", "io", "uy", "öé")]
    out = []
    for k in range(n):
        words = ["w", "the", "That"] * rng.randrange(1, 10)
        if rng.random() < 0.8:
            words += [rng.choice([w, w.title()]) for w in rng.sample(subjects[k % 4], rng.randrange(3, 9))] + rng.sample(subjects[(k + 1) % 4], rng.randrange(2))
        rng.shuffle(words)
        out.append((k, rng.choice([" ", " ", ", "]).join(words), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c"]), "clash"))
    return out


def brute_topics(texts: list[str], p: mixing.Params) -> list[str]:
    found = [set(w[:4] for w in re.findall(r"[^\W\d_]{4,}", t.lower())) for t in texts]
    counts, total = Counter(w for f in found for w in f), len(texts)
    known = sorted((w for w, n in counts.items() if n * p.most_docs <= total <= n * p.least_docs), key=lambda w: (-counts[w], w))[: p.terms]
    found = [f & set(known) for f in found]
    anchors: list[str] = []
    for w in known[: p.seeds]:
        far = all(sum(w in f and a in f for f in found) * total <= p.lift * counts[w] * counts[a] for a in anchors)
        if far and len(anchors) < p.topics:
            anchors.append(w)
    own = {a: a for a in anchors}
    for k in range(p.rounds + 1):
        votes = [Counter(own[w] for w in f if w in own) for f in found]
        told = [min(v, key=lambda t, v=v: (-v[t], t)) if v else mixing.OTHER for v in votes]
        if k == p.rounds:
            return told
        use = Counter((w, t) for f, t in zip(found, told, strict=True) if t != mixing.OTHER for w in f)
        size = Counter()
        for (_, t), n in use.items():
            size[t] += n
        own = {}
        for w, t in sorted(use, key=lambda x: (-use[x] / size[x[1]], x[1])):
            own.setdefault(w, t)
    return []


def test_raked_sums_meet_the_targets(spark):
    rng = np.random.default_rng(0)
    cells = [(s, x, t, int(rng.integers(50, 900))) for s in "abc" for x in ("en", "de") for t in ("u", "v", "w")]
    p = mixing.Params(shares={"source": {"a": 0.2, "b": 0.5, "c": 0.3}}, powers={"lang": 0.5, "topic": 0.0}, rate=0.05, sweeps=15)
    got = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), p).toPandas()
    total = sum(c[3] for c in cells)
    assert np.allclose(got.groupby("source").weight.sum().sort_index(), [0.2, 0.5, 0.3], atol=1e-6)
    langs = np.sqrt([sum(c[3] for c in cells if c[1] == x) for x in ("de", "en")])
    assert np.allclose(got.groupby("lang").weight.sum().sort_index(), langs / langs.sum(), atol=1e-6)
    assert np.allclose(got.groupby("topic").weight.sum(), 1 / 3, atol=1e-6)
    assert np.allclose(got.probability, got.weight * p.rate * total / got.tokens)
    assert np.allclose(got[["source_residual", "lang_residual", "topic_residual"]], 0, atol=1e-6)


def test_residuals_tell_what_goals_the_documents_cannot_meet(spark):
    cells = [("a", "en", "u", 900), ("a", "de", "u", 80), ("b", "en", "u", 20)]
    p = mixing.Params(shares={"source": {"a": 0.5, "b": 0.5}}, powers={"lang": 1.0, "topic": 1.0}, rate=0.5)
    got = mixing.rake(spark.createDataFrame(cells, "source string, lang string, topic string, tokens long"), p).toPandas()
    sums = got.groupby("source").weight.sum()
    assert np.isclose(sums["b"], 20 / 500)  # all it has
    off = got.set_index(["source", "lang"]).source_residual
    assert np.isclose(off["b", "en"], sums["b"] - 0.5) and np.isclose(off["a", "en"], sums["a"] - 0.5)
    assert (got.probability <= 1).all() and got.probability.max() == 1


def test_documents_stay_by_their_cells_probability(spark):
    data = rows(4000)
    docs = spark.createDataFrame(data, SCHEMA).repartition(5)
    p = mixing.Params(rate=0.4)
    out = mixing.mix(docs, p=p).toPandas()
    assert list(out.columns) == ["doc_id", "text", "lang", "source", *mixing.ADDED]
    told = dict(enumerate(brute_topics([t for _, t, *_ in data], p)))
    assert dict(zip(out.doc_id, out.mix_topic, strict=True)) == {k: told[k] for k in out.doc_id}
    by_subject = Counter((k % 4, t) for k, t in told.items() if t != mixing.OTHER)  # topics are the subjects that texts were made of
    assert sum(max(n for (_, u), n in by_subject.items() if u == t) for t in {t for _, t in by_subject}) > 0.9 * sum(by_subject.values())
    assert 0.15 < sum(t == mixing.OTHER for t in told.values()) / len(told) < 0.25
    for d, column in (("source", "source"), ("lang", "lang"), ("topic", "mix_topic")):  # one residual for each value
        assert (out.fillna({"lang": "unknown"}).groupby(column)[f"mix_{d}_residual"].nunique() == 1).all()
    assert sorted(r.doc_id for r in mixing.sample(docs, p=p).where("mix_topic = 'clash'").collect()) == sorted(out.doc_id)
    tokens = sum(t.count(" ") + 1 for _, t, *_ in data)
    assert abs(out.mix_tokens.sum() / tokens - 0.4) < 0.03
    assert (out.mix_probability <= 1).all()
    again = mixing.mix(docs.repartition(2), p=p).toPandas()
    assert sorted(out.doc_id) == sorted(again.doc_id)


def test_nulls_empty_texts_repeats_and_no_rows(spark):
    data = [(1, None, "en", "a", ""), (None, "x y", None, None, ""), (3, "x", "en", "a", ""), (3, "x", "en", "a", ""), (5, "", "en", "a", ""), (6, "  ", "en", "a", "")]
    out = mixing.mix(spark.createDataFrame(data, SCHEMA), p=mixing.Params(rate=1.0)).collect()
    assert sorted(str(r.doc_id) for r in out) == ["3", "3", "None"]
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_are_read_once_and_plans_stay_short(spark):
    data = rows(300)
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: (read.add(1), t)[1], "string").asNondeterministic()
    docs = spark.createDataFrame(data, SCHEMA).withColumn("text", seen("text")).withColumn("nothing", F.lit(None))
    out = mixing.mix(docs, columns=("doc_id", "nothing"))
    got = out.collect()
    assert got and out.columns == ["doc_id", "nothing", *mixing.ADDED] and {r.nothing for r in got} == {None}
    assert read.value == len(data)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("HashAggregate") <= 1
    assert mixing.sample(docs).columns == docs.columns
