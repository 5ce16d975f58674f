from __future__ import annotations

import hashlib
import random

import numpy as np

from pyspark.sql import functions as F

from tracewell.llm import fingerprint as fp


def lz78(text: str) -> list[str]:
    seen, phrase = [], ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.append(phrase)
            phrase = ""
    return seen


def test_phrases_and_hashes():
    rng = random.Random(1)
    for n in (0, 1, 7, 900):
        text = "".join(rng.choices("abé€😀 ", k=n))
        seen: set[str] = set()
        lengths, left = fp.parse(text, seen)
        assert seen == set(lz78(text))
        assert sum(lengths) + len(left) == len(text)
        hashes = fp.phrase_hashes(text, lengths)
        assert len(set(hashes.tolist())) == len(seen)
        again = fp.phrase_hashes("xyz" + text, [3, *lengths])
        assert (again[1:] == hashes).all()  # a phrase hashes alike wherever it lies


def test_likeness_estimates_the_jaccard_likeness_of_phrase_sets():
    rng = random.Random(2)
    a = "".join(rng.choices("abcdef", k=6000))
    b = a[:3000] + "".join(rng.choices("abcdef", k=3000))
    x, y = set(lz78(a)), set(lz78(b))
    est = fp.likeness(fp.fingerprints(a)[0], fp.fingerprints(b)[0])
    assert abs(est - len(x & y) / len(x | y)) < 0.2
    assert fp.likeness(fp.fingerprints("")[0], fp.fingerprints("")[0]) == 1.0


def test_every_document_meets_its_follower(spark):
    rng = random.Random(5)
    rows = [(k * 7 % 101, "".join(rng.choices("abcé 😀", k=rng.choice([0, 1, 3, 50, 400])))) for k in range(60)]
    rows[3] = (rows[3][0], None)
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, r int, guest string").repartition(7)
    got = {r.doc_id: r for r in fp.edited_likeness(docs).collect()}
    assert len(got) == len(rows)
    ordered = sorted((i, t or "") for i, t in rows)
    for k, (i, text) in enumerate(ordered):
        ahead = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + ahead[:cut]
        own, other = fp.fingerprints(text)[0], fp.fingerprints(edited)[0]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), other.tobytes().hex())
        assert r.near_edited == fp.likeness(own, other)
        assert r.near_next == fp.likeness(own, fp.fingerprints(ahead)[0])


def test_one_row_repeated_ids_and_no_rows(spark):
    schema = "doc_id long, text string"
    one = fp.edited_likeness(spark.createDataFrame([(None, "abcdefgh")], schema)).collect()
    assert [(r.doc_id, r.edited_sha256, r.near_next) for r in one] == [(None, hashlib.sha256(b"abcdefab").hexdigest(), 1.0)]
    twice = fp.edited_likeness(spark.createDataFrame([(4, "b" * 8), (4, "a" * 8), (4, "a" * 8)], schema)).collect()
    want = [("a" * 8), ("a" * 6 + "bb"), ("b" * 6 + "aa")]
    assert sorted(r.edited_sha256 for r in twice) == sorted(hashlib.sha256(x.encode()).hexdigest() for x in want)
    assert fp.edited_likeness(spark.createDataFrame([], schema)).count() == 0


def test_long_texts_are_parsed_whole():
    a, b = "ab" * 40_000 + "xyz", "ab" * 40_000 + "xyw"
    assert (fp.fingerprints(a)[0] == fp.fingerprints(a)[0]).all()
    whole, _ = fp.fingerprints(a, "Q", len(a) - 1)
    assert (whole == fp.fingerprints(a)[0]).all()
    assert np.array_equal(fp.fingerprints(b, "z", len(b) - 1)[1], fp.fingerprints(a)[0])


def test_an_id_that_most_rows_repeat_is_dealt_out(spark):
    rng = random.Random(6)
    rows = [(7 if k % 3 else None if k % 2 else k, "".join(rng.choices("abc", k=40)) + str(k)) for k in range(300)]
    out = fp.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))
    parts = out.select(F.spark_partition_id().alias("p"), "doc_id").where("doc_id = 7").groupBy("p").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 150
    got = out.collect()
    ahead = sorted(r.edited_sha256 for r in got)
    # every text once, and every text followed by one other: the ring is closed
    assert sorted(r.fingerprint for r in got) == sorted(fp.fingerprints(t)[0].tobytes().hex() for _, t in rows)
    assert len(set(ahead)) == 300
