from __future__ import annotations

import math

import numpy as np
import pytest

from tracewell.llm import embeddings as em


def test_estimates_are_unbiased_and_within_their_bounds():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 64))
    y = 0.8 * x + 0.6 * rng.standard_normal((1500, 64))
    true = em.unit(x) @ em.unit(y).T
    guess, error = em.estimate(*em.encode(x), y)
    off = guess - true
    assert abs(np.diag(off).mean()) < 0.005 and abs(off.mean()) < 0.005
    assert (np.abs(off) <= em.ERRORS * error[:, None]).all()
    assert 0.5 < (np.abs(np.diag(off)) <= error).mean() < 0.95


@pytest.mark.parametrize("cap", [4096, 3])
def test_links_match_brute_force(spark, cap, monkeypatch):
    monkeypatch.setattr(em, "BUCKET_CAP", cap)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((80, 64))
    many = [base, base[:9] + 0.25 * rng.standard_normal((9, 64)), base[:5] * 3.0, base[:4], base[:1] + 0.1 * rng.standard_normal((20, 64))]
    edge = base[20:60] / np.linalg.norm(base[20:60], axis=1, keepdims=True)
    side = rng.standard_normal((40, 64))
    side -= (side * edge).sum(axis=1, keepdims=True) * edge
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cosine = rng.uniform(0.88, 0.93, (40, 1))
    many.append(cosine * edge + np.sqrt(1 - cosine**2) * side)
    v = np.concatenate(many).astype(np.float32)
    rows = [(3 * k, [float(c) for c in x], 0) for k, x in enumerate(v)]
    odd = [None, [], [0.0] * 64, [float("nan")] + [1.0] * 63, [math.inf] + [1.0] * 63, [None] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]
    rows += [(1000 + k, x, 1) for k, x in enumerate(odd)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key int").repartition(5)
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in em.near_vectors(df, "vec_id", "embedding").collect()}
    d = v.astype(np.float64)
    n = np.sqrt((d * d).sum(axis=1))
    links = (d @ d.T / np.outer(n, n) >= 0.9) & ~np.eye(len(d), dtype=bool)
    root = np.arange(len(d))
    for _ in range(len(d)):
        root = np.minimum(root, np.where(links, root[None, :], len(d)).min(axis=1))
    want = {3 * k: (int(links[k].sum()), int(3 * root[k]), bool(root[k] == k)) for k in range(len(d))}
    want |= {1000 + k: (0, 1000 + k, True) for k in range(6)} | {1006: (1, 1006, True), 1007: (1, 1006, False)}
    assert got == want


@pytest.mark.parametrize("rows", [2_000, 50_000, 1_000_000, 1_000_000_000])
def test_tables_meet_pairs_at_the_threshold_at_any_size(rows):
    rng = np.random.default_rng(2)
    x, side = em.unit(rng.standard_normal((20_000, 64))), rng.standard_normal((20_000, 64))
    side = em.unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    y = 0.9 * x + math.sqrt(1 - 0.9**2) * side
    lanes, count = em.tables(rows, 0.9)
    apart = np.arange(len(x))
    for table in range(1, count + 1):
        apart = apart[em.table_keys(x[apart], table, lanes) != em.table_keys(y[apart], table, lanes)]
    assert len(apart) <= 40  # 20 are expected


def test_a_large_group_of_near_copies_and_many_small_ones(spark, monkeypatch):
    monkeypatch.setattr(em, "BUCKET_CAP", 128)
    rng = np.random.default_rng(5)
    center = rng.standard_normal(32)
    v = [center + 0.05 * rng.standard_normal((300, 32)), rng.standard_normal((900, 32))]
    v.append(v[1][:100] + 0.2 * rng.standard_normal((100, 32)))
    v = np.concatenate(v).astype(np.float32)
    df = spark.createDataFrame([(k, x.tolist(), "n", 1.0) for k, x in enumerate(v)], "vec_id long, embedding array<float>, n_links string, cid double").repartition(7)
    got = {r.id: r.n_links for r in em.near_vectors(df, "vec_id", "embedding").collect()}
    d = em.unit(v.astype(np.float64))
    want = (d @ d.T >= 0.9).sum(axis=1) - 1
    assert want[:300].min() >= 299 and want.sum() > 300 * 299
    assert got == dict(enumerate(want.tolist()))


def test_no_rows_null_and_repeated_ids(spark):
    schema = "vec_id long, embedding array<double>"
    assert em.near_vectors(spark.createDataFrame([], schema), "vec_id", "embedding").count() == 0
    df = spark.createDataFrame([(4, [1.0, 0.0]), (4, [0.0, 1.0]), (None, [0.0, 1e300]), (None, None)], schema)
    got = sorted((str(r.id), r.n_links, str(r.component_id), r.kept) for r in em.near_vectors(df, "vec_id", "embedding").collect())
    assert got == [("4", 0, "4", True), ("4", 1, "4", True), ("None", 0, "None", True), ("None", 1, "4", False)]
