"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracewell.llm import queries, spelling

SCHEMA = "doc_id long, text string, word string, n int, cell long"


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(docs: list[tuple], misspell: int | None, least: int = 6, often: int = 5) -> dict[str, int]:
    n: Counter = Counter()
    for key, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if misspell and h % misspell == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def brute_variants(n: dict[str, int], ratio: int = 5) -> set[tuple]:
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@pytest.fixture(scope="module")
def docs() -> list[tuple]:
    rng = random.Random(12)
    parts = ["tion", "eau", "ment", "sch", "é", "ñ", "un", "re", "l", "a", "×"]
    known = ["".join(rng.choices(parts, k=rng.randrange(2, 5))) for _ in range(150)]
    rows = []
    for k in range(120):
        text = "".join(w.capitalize() + rng.choice(" .,7\n") for w in rng.choices(known, weights=[1 / (i + 1) for i in range(150)], k=90))
        rows.append((k, text, "x", 1, 2))
    long = "ab" * 700
    rows += [(200 + k, f"{long} {long}c {long[:-1]}", "x", 1, 2) for k in range(6)] + [(300 + k, long, "x", 1, 2) for k in range(30)]
    return [*rows, rows[0], rows[0], (None, None, None, None, None), (None, known[0] * 2, "x", 1, 2), (400, "", "x", 1, 2), (401, "12 !?", "x", 1, 2)]


@pytest.mark.parametrize("params", [{}, {"cell_words": 2}, {"cell_words": 2, "cell_rows": 12}, {"groups": 3, "cell_rows": 40}])
def test_variants_equal_brute_force(spark, docs, params):
    p = spelling.Params(**params)
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = spelling.variants(spelling.word_counts(df, misspell=7, p=p), p)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows, want = [tuple(r) for r in got.collect()], brute_variants(brute_counts(docs, 7))
    assert len(rows) == len(want) and set(rows) == want
    assert sum(r[4] for r in rows) > 50 and any(r[1] for r in rows)


def test_query_follows_its_contract(spark, docs, tmp_path):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in queries.op12_spelling(spark, str(tmp_path)).collect()]
    assert set(rows) == brute_variants(brute_counts(docs, 199)) and len(rows) == len(set(rows))


def test_chains_of_forms_end_at_their_root(spark):
    chain = [("planets", 5), ("planetss", 25), ("planetsss", 125), ("planetssss", 625), ("planetsssss", 3125), ("plbnets", 5), ("unrelated", 9), (None, 3)]
    got = {r.word: (r.form, r.root, r.n_near) for r in spelling.variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert got["planets"] == ("planetss", "planetsssss", 2) and got["planetssss"] == ("planetsssss", "planetsssss", 2)
    assert got["planetsssss"] == (None, "planetsssss", 1) and got["unrelated"] == (None, "unrelated", 0) and len(got) == 7


def test_no_words(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert spelling.variants(spelling.word_counts(empty)).collect() == []
    assert spelling.variants(spelling.word_counts(spark.createDataFrame([(1, "a b c", "x", 1, 2)], SCHEMA))).collect() == []


def test_search_spends_one_surplus_and_one_deficit():
    rng = np.random.default_rng(3)
    rows = np.unique(rng.integers(0, 3, (300, 5)), axis=0)
    trie = spelling.Trie(rows)
    found = {(int(r), int(leaf)): int(s) for row, node, spent in trie.search(rows) for r, leaf, s in zip(row, node, spent, strict=True)}
    for i, a in enumerate(rows):
        for j, b in enumerate(trie.rows):
            d = b - a
            up, down = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
            fits = abs(d).max() <= 1 and len(up) <= 1 and len(down) <= len(up) and (not len(down) or up[0] < down[0])
            assert ((i, j) in found) == fits and (not fits or found[i, j] == len(up) + len(down))


def test_pairs_of_words_of_all_lengths():
    rng = random.Random(4)
    raw = ["".join(rng.choices("abé", k=k)) for k in (6, 7, 39, 40, 41, 41, 42, 80) for _ in range(3)]
    raw += [w[:3] + w[4:] for w in raw] + [w + "a" for w in raw]
    words = spelling.Words(pa.array([w.encode("latin-1") for w in raw], pa.binary()), np.arange(256) % 4, 4)
    a, b = (x.ravel() for x in np.indices((len(raw), len(raw))))
    assert words.differ_by_one(a, b).tolist() == [one_apart(raw[i], raw[j]) for i, j in zip(a, b, strict=True)]
