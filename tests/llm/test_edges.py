"""Nulls, empty and very long values, repeated rows, clashing names and empty tables, operator by operator."""

from __future__ import annotations

import datetime

from tracewell.llm import embeddings, langid, quality, urlfilter

CLASH = ", lang_pred string, score double, n_chars int, row int, h long"
REST = ("x", 0.5, 3, 1, 2)


def test_langid_repeats_and_clashing_names(spark):
    rows = [(k, t, x, *REST) for k, (t, x) in enumerate([("the of and thing", "en"), ("der die und", "de")] * 6)]
    docs = spark.createDataFrame([*rows, rows[0], rows[0], (None, None, None, *REST), (50, "the " * 60_000, None, *REST)], "doc_id long, text string, lang string" + CLASH)
    model = langid.fit(docs, "text", "lang")
    got = langid.identify(docs, model, also=("doc_id", "score", "lang_pred", "n_chars"))
    assert got.columns == ["doc_id", "n_chars", "lang_pred", "score"]
    found = sorted((str(r.doc_id), r.lang_pred, r.n_chars) for r in got.collect())
    assert found.count(("0", "en", 3)) == 3 and ("None", "und", 3) in found and ("50", "en", 3) in found and len(found) == 16


def test_langid_learns_more_languages_than_are_held_at_once(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGS_AT_ONCE", 4)
    names = [f"l{k:02d}" for k in range(11)]
    docs = spark.createDataFrame([(" ".join([chr(97 + 2 * k) * 3] * 5), x) for k, x in enumerate(names)] * 3, "text string, lang string").repartition(3)
    small = langid.Params(buckets=1 << 10)
    model = langid.fit(docs, "text", "lang", small)
    assert model.langs == names and all(r.lang_pred == r.lang for r in langid.identify(docs, model, also=("lang",)).collect())


def test_quality_repeats_and_clashing_names(spark):
    rows = [(str(k % 40), ("good words here " if k % 2 else "BAD!! BAD!! ") * (1 + k % 7) + str(k % 40), k % 2, *REST) for k in range(80)]
    docs = spark.createDataFrame([*rows, (None, None, 1, *REST), (None, "", 0, *REST)], "doc_id string, text string, quality int" + CLASH).repartition(3)
    model = quality.fit(docs, "doc_id", "text", "quality", quality.Params(buckets=1 << 10, rows_per_class=15))
    got = quality.score(docs, model, also=("doc_id", "quality", "score", "row"))
    assert got.columns == ["doc_id", "quality", "row", "score"] and got.count() == 82
    assert all((r.score > 0.5) == r.quality for r in got.collect() if r.doc_id)


def test_a_repeated_id_brings_no_more_than_its_share_to_the_sample(spark, monkeypatch):
    seen = []
    descend = quality._descend
    monkeypatch.setattr(quality, "_descend", lambda ids, *rest: seen.append(len(ids)) or descend(ids, *rest))
    rows = [(1, f"word{k}", k % 2) for k in range(500)] + [(2, "same text", 1)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    quality.fit(docs, "doc_id", "text", "quality", quality.Params(buckets=1 << 10, rows_per_class=20, epochs=1))
    assert seen == [40]


def test_urls_null_odd_very_long_and_repeated(spark):
    day = datetime.date(2024, 2, 1)
    long = "http://spam.org/" + "x/" * 50_000
    captures = spark.createDataFrame(
        [(1, long, day, "a"), (1, long, day, "a"), (2, None, day, "b"), (3, "no url", day, "c"), (4, "http://spam.org", None, "d"), (None, "http://spam.org", day, "e")],
        "page_id long, url string, fetched_on date, first_rule string",
    )
    entries = spark.createDataFrame(
        [("l", "host", "spam.org", "add", datetime.date(2024, 1, 1)), ("l", "host", None, "add", day), ("l", "host", "x.org", "add", None)],
        "list string, kind string, value string, action string, day date",
    )
    got = urlfilter.judge(captures, entries)
    found = sorted((str(r.page_id), r.n_active, str(r.first_rule), r.blocked) for r in got.collect())
    rule = "l/host/spam.org"
    assert found == [("1", 1, rule, True)] * 2 + [("2", 0, "None", False), ("3", 0, "None", False), ("4", 0, "None", False), ("None", 1, rule, True)]
    assert got.columns.count("first_rule") == 1
    assert urlfilter.judge(captures.limit(0), entries).count() == 0 and urlfilter.judge(captures, entries.limit(0)).where("blocked").count() == 0


def test_vectors_with_clashing_names_and_very_long_ones(spark):
    rows = [(k, [float((k + j) % 3 - 1) for j in range(1000)], *range(6)) for k in range(6)]
    names = "id long, vector int, cid int, n int, component_id int, kept int"
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, " + names)
    got = {r.id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df, "vec_id", "embedding").collect()}
    assert got == {k: (1, k % 3) for k in range(6)}


def test_the_sample_is_bounded_by_its_features(spark, monkeypatch):
    seen = []
    descend = quality._descend
    monkeypatch.setattr(quality, "_descend", lambda ids, *rest: seen.append(sum(map(len, ids))) or descend(ids, *rest))
    rows = [(k, " ".join(f"word{k}x{j}" for j in range(60)), k % 2) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    for features in (20_000_000, 5_000):
        quality.fit(docs, "doc_id", "text", "quality", quality.Params(buckets=1 << 12, epochs=1, features=features))
    assert seen[0] > 20_000 and 3_000 < seen[1] <= 5_000


def test_very_many_equal_rows_give_each_surrounding_once(spark):
    from tracewell.llm import substrings

    passage = "".join(chr(97 + (k * k) % 23) for k in range(450))
    rows = [(1, "start " + passage + " end")] * 300 + [(k, f"{k} " * 9 + passage + f" {k}") for k in range(2, 12)] + [(20, "else")]
    got = {r.doc_id: r.n_removed for r in substrings.removal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[20] == 0 and got[1] == len(rows[0][1]) and all(450 <= got[k] <= 453 for k in range(2, 12))
