"""Order-keeping diffs against a plain patience alignment."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from tracewell.operators import alignment


def plain_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest rising sequence by comparing all pairs, with the tie rule of the operator."""
    best: list[tuple[int, int]] = []
    for k, (_, j) in enumerate(pairs):
        before = [(best[m][0], -pairs[m][1], m) for m in range(k) if pairs[m][1] < j]
        w, _, m = max(before, default=(0, 0, -1))
        best.append((w + 1, m))
    k = max(range(len(pairs)), key=lambda k: (best[k][0], -pairs[k][1]), default=-1)
    out = []
    while k >= 0:
        out.append(pairs[k])
        k = best[k][1]
    return out[::-1]


def plain_align(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    gaps, aligned, repeated = [(0, len(left), 0, len(right))], [], False
    while True:
        gaps = [g for g in gaps if set(left[g[0] : g[1]]) & set(right[g[2] : g[3]])]
        if not gaps:
            return sorted(aligned)
        found, after = [], []
        for a, b, c, d in gaps:
            pairs, lo, hi, low, high = [], a, b, c, d
            while lo < hi and low < high and left[lo] == right[low]:
                pairs.append((lo, low))
                lo, low = lo + 1, low + 1
            while lo < hi and low < high and left[hi - 1] == right[high - 1]:
                hi, high = hi - 1, high - 1
                pairs.append((hi, high))
            n, m = Counter(left[lo:hi]), Counter(right[low:high])
            if repeated:
                seen: Counter = Counter()
                where = {}
                for j in range(low, high):
                    where[right[j], seen[right[j]]] = j
                    seen[right[j]] += 1
                seen.clear()
                some = []
                for i in range(lo, hi):
                    if (left[i], seen[left[i]]) in where:
                        some.append((i, where[left[i], seen[left[i]]]))
                    seen[left[i]] += 1
            else:
                some = [(i, right.index(left[i], low)) for i in range(lo, hi) if n[left[i]] == 1 and m[left[i]] == 1]
            pairs = sorted(pairs + plain_rising(some))
            found += pairs
            edge = [(a - 1, c - 1), *pairs, (b, d)]
            after += [(p + 1, q, s + 1, t) for (p, s), (q, t) in zip(edge, edge[1:], strict=False)]
        if not found:
            repeated = True
            continue
        repeated = False
        aligned += found
        gaps = after


def plain_hunks(left: list[str], right: list[str]) -> list[tuple]:
    pairs, out, at = plain_align(left, right), [], (0, 0)
    for i, j in [*pairs, (len(left), len(right))]:
        a, b = i - at[0], j - at[1]
        if a or b:
            out.append(("removed" if not b else "added" if not a else "modified", at[0], a, at[1], b))
        if (i, j) != (len(left), len(right)):
            last = out[-1] if out and out[-1][0] == "equal" and out[-1][1] + out[-1][2] == i and out[-1][3] + out[-1][4] == j else None
            if last:
                out[-1] = ("equal", last[1], last[2] + 1, last[3], last[4] + 1)
            else:
                out.append(("equal", i, 1, j, 1))
        at = (i + 1, j + 1)
    return out


def logs(seed: int) -> dict[str, tuple[list[str], list[str]]]:
    rng = random.Random(seed)
    base = [f"line {k}" for k in range(120)]
    changed = list(base)
    for k in rng.sample(range(110), 12):
        changed[k : k + 1] = rng.choice([[], ["new"], [changed[k], "more"], [changed[k] + "!"]])
    for _ in range(4):  # moves
        a, n, b = rng.randrange(90), rng.randrange(1, 8), rng.randrange(90)
        part = changed[a : a + n]
        del changed[a : a + n]
        changed[b:b] = part
    few = [rng.choice("abc") for _ in range(40)]
    mixed = [rng.choice(["", "x", f"u{k}"]) for k in range(60)]
    shuffled = list(base)
    rng.shuffle(shuffled)
    return {
        "moved": (base, changed), "few": (few, [rng.choice("abcd") for _ in range(35)]), "mixed": (mixed, [x for x in mixed if rng.random() < 0.8]),
        "shuffled": (base, shuffled), "same": (base[:9], base[:9]), "gone": (base[:5], []), "new": ([], base[:4]), "other": (["p"], ["q", "q"]), "swapped": (["a", "a", "b", "b"], ["b", "b", "a", "a"]),
    }


@pytest.mark.parametrize(("seed", "chunk", "small"), [(1, 100_000, 4096), (3, 7, 0)])
def test_hunks_of_several_files(spark, seed, chunk, small):
    files = logs(seed)
    if not small:  # all rounds over all lines
        files = {f: files[f] for f in ("moved", "swapped")}
    side = lambda k: spark.createDataFrame([(f, n, t) for f, both in files.items() for n, t in enumerate(both[k])], "file string, line_no long, text string").repartition(3)
    got: dict = {f: [] for f in files}
    for r in alignment.hunks(side(0), side(1), chunk, small).collect():
        got[r.file].append(tuple(r)[1:])
    for f, (left, right) in files.items():
        assert sorted(got[f], key=lambda h: (h[1], h[3], h[2] + h[4])) == plain_hunks(left, right), f
        kinds = Counter({k: sum(h[2] for h in got[f] if h[0] == k) for k in ("equal", "removed", "modified")})
        assert sum(kinds.values()) == len(left) and sum(h[4] for h in got[f]) == len(right)


def test_gaps_of_short_lists():
    for seed in range(40):
        for left, right in logs(seed).values():
            assert sorted(alignment.align_gap(left, right)) == plain_align(left, right)


def test_longest_rising_sequence():
    rng = random.Random(9)
    for _ in range(300):
        places = rng.sample(range(40), rng.randrange(12))
        kept = alignment.rising(places, [1] * len(places))
        assert [(k, places[k]) for k in kept] == plain_rising(list(enumerate(places)))
    assert alignment.rising([5, 1, 2], [3, 1, 1]) == [0] and alignment.rising([5, 1, 2], [2, 1, 1]) == [1, 2]


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], "file string, line_no long, text string")
    assert alignment.hunks(empty, empty).collect() == []
    some = spark.createDataFrame([("f", 0, None), ("f", 1, "x")], empty.schema)
    assert [tuple(r) for r in alignment.hunks(some, empty).collect()] == [("f", "removed", 0, 2, 0, 0)]
    assert [tuple(r) for r in alignment.hunks(some, some).collect()] == [("f", "equal", 0, 2, 0, 2)]
