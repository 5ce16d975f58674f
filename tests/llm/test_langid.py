from __future__ import annotations

import math
import random
from collections import Counter

from tracewell.llm import langid

SETS = {"en": "the of and thing", "de": "der die und schön", "fr": "le la été où"}


def rows(n: int, seed: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(SETS[lang].split(), k=rng.randrange(1, 40))), lang) for k in range(n) for lang in [rng.choice(sorted(SETS))]]


def brute(train: list[tuple], text: str, p: langid.Params) -> tuple[str, float]:
    grams, docs = {}, Counter(lang for _, _, lang in train)
    for _, t, lang in train:
        for w in langid.words_of(t):
            grams.setdefault(lang, Counter()).update(langid.buckets_of([w], p)[0].tolist())
    score = {}
    for lang in sorted(docs):
        total = sum(grams[lang].values()) + p.smoothing * p.buckets
        score[lang] = math.log(docs[lang] / len(train)) + sum(
            math.log((grams[lang][b] + p.smoothing) / total) for w in langid.words_of(text) for b in langid.buckets_of([w], p)[0].tolist()
        )
    best = max(score.values())
    return max(score, key=score.get), 1 / sum(math.exp(s - best) for s in score.values())


def test_scores_match_naive_bayes_by_hand(spark):
    train, test = rows(60), rows(40, 1)
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(train, schema).repartition(5), "text", "lang")
    got = langid.identify(spark.createDataFrame(test, schema), model, also=("doc_id",)).collect()
    for r, (k, text, lang) in zip(sorted(got), test, strict=True):
        want = brute(train, text, model.params)
        assert (r.doc_id, r.lang_pred) == (k, want[0])
        assert abs(r.score - want[1]) < 1e-3
    assert sum(r.lang_pred == t[2] for r, t in zip(sorted(got), test, strict=True)) >= 38


def test_grams_of_a_word():
    p = langid.Params(buckets=1 << 30)
    at, of = langid.buckets_of(["ab", "²", "c"], p)
    assert sorted(of.tolist()) == [0] * 7 + [2] * 4  # a b, _a ab b_, _ab ab_; c, _c c_, _c_
    again, _ = langid.buckets_of(["ab"], p)
    assert set(again.tolist()) == set(at[of == 0].tolist()) and len(set(again.tolist())) == 7


def test_texts_without_letters_nulls_long_words_and_no_languages(spark):
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame([*rows(30), (99, "der", None), (98, None, "de")], schema), "text", "lang")
    odd = [(0, None, None), (1, "", None), (2, "12 ²½ _%", None), (3, "the" * 50_000, None), (4, "the of", "xx")]
    got = [(r.doc_id, r.lang_pred, r.score > 0) for r in sorted(langid.identify(spark.createDataFrame(odd, schema), model, also=("doc_id",)).collect())]
    assert got == [(0, "und", False), (1, "und", False), (2, "und", False), (3, "en", True), (4, "en", True)]
    empty = spark.createDataFrame([], schema)
    none = langid.fit(empty, "text", "lang")
    assert [r.lang_pred for r in langid.identify(spark.createDataFrame(odd, schema), none).collect()] == ["und"] * 5
    assert langid.identify(empty, model).count() == 0
