from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import substrings
from tracewell.llm.suffix import deep_shallow_sort


def brute(texts: list[bytes], length: int) -> list[list[bool]]:
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append(gone)
    return out


def test_deep_shallow_sort_matches_sorted():
    rng = random.Random(4)
    base = bytes(rng.choices(range(4), k=400))
    strings = [base[: rng.randrange(401)] + bytes(rng.choices(range(3), k=rng.randrange(40))) for _ in range(300)]
    strings = [s[:400] for s in strings] + strings[:20]
    strings = [s[:400] for s in strings]
    group = np.sort(np.array([rng.randrange(5) for _ in strings]))
    order, shared = deep_shallow_sort(strings, group, 400)
    full = [s.ljust(400, b"\0") for s in strings]
    assert [(group[i], full[i]) for i in order] == sorted((g, s) for g, s in zip(group, full, strict=True))
    for k in range(1, len(order)):
        i, j = order[k - 1], order[k]
        want = next((p for p in range(400) if full[i][p] != full[j][p]), 400) if group[i] == group[j] else 0
        assert shared[k] == want


@pytest.fixture
def corpus() -> list[str | None]:
    rng = random.Random(9)

    def text(n: int) -> str:
        return "".join(rng.choices("abcdefgh é", k=n))

    passage, other = text(900), text(450)
    texts: list[str | None] = ["", None, "short", text(2000), text(399)]
    for k in range(12):
        texts.append(text(rng.randrange(300)) + passage[: 500 + 30 * k] + text(rng.randrange(300)))
        texts.append(text(100) + other[k : 402 + k] + text(100))
    whole = text(1500)
    texts += [whole, whole, whole[:700] + "X" + whole[701:], whole + "tail"]
    texts += ["ab" * 600, "xyz" * 500, "xyz" * 300 + text(200), "q" * 400, "q" * 401]
    texts += [text(500) + passage[100:501] + other[:430] + passage[450:900] + text(50)]
    texts += [other[:399] + "!", "?" + other[:399]]
    return texts


@pytest.mark.parametrize(("cap", "length"), [(50_000, 400), (5, 400), (2, 400), (5, 200), (3, 90), (2, 9)])
def test_removed_bytes_match_brute_force(spark, corpus, cap, length, monkeypatch):
    monkeypatch.setattr(substrings, "GRAM_CAP", cap)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(corpus)], "doc_id long, text string, spans string").repartition(6)
    got = {r.doc_id: r for r in substrings.removal_digests(docs, length=length).collect()}
    raws = [(t or "").encode() for t in corpus]
    assert len(got) == len(corpus)
    for i, (raw, gone) in enumerate(zip(raws, brute(raws, length), strict=True)):
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(raw), sum(gone), runs), i
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
        assert r.text == kept.decode("utf-8", "replace")


def test_a_hot_gram_is_split_and_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(substrings, "GRAM_CAP", 8)
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    passage = text(900)
    texts = []
    for k in range(60):  # near copies of one passage, and parts of it in other surroundings
        at = rng.randrange(900)
        texts.append(passage[:at] + "!" * (k % 3) + passage[at:] if k % 2 else text(k) + passage[at // 3 : at // 3 + 330 + 5 * k] + text(60 - k))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.n_removed for r in substrings.removal_digests(docs).collect()}
    assert got == {i: sum(gone) for i, gone in enumerate(brute([t.encode() for t in texts], 400))}


def test_texts_lose_whole_characters_only(spark, corpus):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(corpus)], "doc_id long, text string, also string")
    out = substrings.without_repeats(docs)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    raws = [(t or "").encode() for t in corpus]
    for i, (raw, gone) in enumerate(zip(raws, brute(raws, 400), strict=True)):
        if corpus[i] is None:
            assert got[i] is None
            continue
        want, at = "", 0
        for c in raw.decode():
            n = len(c.encode())
            want += "" if all(gone[at : at + n]) else c
            at += n
        assert got[i] == want


def test_repeated_rows_null_ids_no_rows_and_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 1000)
    rng = random.Random(1)
    a, b = ("".join(rng.choices("abcdef", k=5000)) for _ in range(2))
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(1, a), (1, a), (None, b), (None, a[2300:2900] + b[:10]), (2, b + "z" + b[1000:1500])], schema)
    got = sorted((str(r.doc_id), r.n_removed) for r in substrings.removal_digests(docs).collect())
    assert got == [("1", 5000), ("1", 5000), ("2", 5500), ("None", 600), ("None", 5000)]
    assert substrings.removal_digests(docs.limit(0)).count() == 0
