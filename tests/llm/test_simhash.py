from __future__ import annotations

import random

import numpy as np
import xxhash

from tracewell.llm import simhash
from tracewell.llm.components import connected_components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def brute_fingerprint(text: str | None) -> int:
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids: list[int], fps: list[int], bits: int = 3) -> dict[int, int]:
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(x, least.get(find(i), x))
    return {x: least[find(i)] for i, x in enumerate(ids)}


def test_fingerprints_and_groups_match_brute_force(spark):
    rng = random.Random(7)
    texts = ["", None, "  \n", "One", "one", "ONE two", "é É", "x" * 3000, "a b c d"]
    base = [" ".join(rng.choices(WORDS, k=200)) for _ in range(6)]
    for text in base:
        words = text.split()
        for _ in range(12):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words))
    rows = [(i * 3 + 1, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, posting int").repartition(5)
    got = {r.id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_groups(docs).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    ids = [r[0] for r in rows]
    want = brute_components(ids, fps)
    assert got == {x: (f, want[x]) for x, f in zip(ids, fps, strict=True)}
    kept = simhash.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_repeated_rows_null_ids_and_no_rows(spark):
    schema = "doc_id long, text string"
    docs = spark.createDataFrame([(5, "same text here"), (5, "same text here"), (None, "same text here"), (None, "other thing")], schema)
    got = sorted((str(r.id), str(r.component_id)) for r in simhash.simhash_groups(docs).collect())
    assert got == [("5", "5"), ("5", "5"), ("None", "5"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in simhash.keep_one_of_each_group(docs).collect()) == ["5", "None"]
    assert simhash.simhash_groups(docs.limit(0)).count() == 0


def test_hot_postings_are_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "POSTING_CAP", 7)
    rng = random.Random(3)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 60:
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)))
    fps = sorted(fps) + [rng.getrandbits(64) for _ in range(30)]
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, *_: docs.selectExpr("id", "fp"))
    docs = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    got = {r.id: r.component_id for r in simhash.simhash_groups(docs).collect()}
    assert got == brute_components(list(range(len(fps))), fps)


def test_every_link_meets_in_a_posting():
    from itertools import combinations

    assert all(any(set(t) <= set(five) for t in simhash.TRIPLES) for five in combinations(range(8), 5))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(7, 7), (3, 1)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 1 for i in range(1, 40)}
