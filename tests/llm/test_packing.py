from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from tracewell.llm import packing
from tracewell.llm.queries import vocabulary

ODD = ["", "a  b", " x", "x ", "\n\n a", "tab\t z", "<|endoftext|> z a<|endoftext|>", "<| x", "don't I'LL we're", "a.", "A.,", "x.\ny.", "½. ª,", "'s. ,", "漢字 かな 😀 x", "12 345 6,7", "a \x1c b\x00 c", "x\n y \nz", "é. ö, x"]


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary()[0])
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ranks", [True, False])
def test_encoder_gives_the_tokenizers_ids(ids_of, ranks, monkeypatch):
    monkeypatch.setattr(packing, "MEMO_WORDS", 5)
    path, other = vocabulary()
    encode = packing.encoder(path, other if ranks else None)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choices("abE é.,'\n\t 12<|>😀", k=40)) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == ids_of(text), repr(text)


def test_every_id_is_packed_once_and_bins_are_few(spark, ids_of):
    rng = random.Random(2)
    texts = [*ODD, None] + [" ".join(rng.choices(["the", "and", "thing", "oreatio"], k=rng.choice([5, 200, 900, 2500]))) for _ in range(120)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, length int").repartition(6)
    rows = packing.pack(docs, *vocabulary()).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for k, text in enumerate(texts):
        ids, at = ids_of(text or "") + [2], 0
        for p, r in enumerate(sorted(by_doc[k], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (p, at)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            assert r.length == 1024 or p == 0
            at += r.length
        assert at == len(ids)
    for some in by_bin.values():
        at = 0
        for r in sorted(some, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert len(by_bin) <= packing.best_fit(Counter(r.length for r in rows)).total()


def test_search_empties_bins_and_keeps_pieces():
    rng = random.Random(3)
    better = 0
    for _ in range(40):
        counts = Counter(rng.randrange(200, 600) for _ in range(120))
        first = packing.best_fit(counts)
        then = packing.local_search(first)
        for bins in (first, then):
            used = Counter()
            for pattern, n in bins.items():
                assert sum(s * k for s, k in pattern) <= 1024
                for s, k in pattern:
                    used[s] += k * n
            assert used == counts
        square = [sum(packing._fill(p) ** 2 * n for p, n in bins.items()) for bins in (first, then)]
        assert square[1] >= square[0] and then.total() <= first.total()
        better += then.total() < first.total()
    assert better


def improving(bins, size=1024):
    """An exchange that makes a partner no emptier than the giver fuller, by trying all."""
    some = {}
    for p in (p for p in bins if packing._fill(p) < size):
        pieces = [s for s, n in p for _ in range(n)]
        some[p] = {(k, sum(x)) for k in (0, 1, 2) for x in combinations(pieces, k)}
    for a in some:
        for b in some:
            if packing._fill(b) < packing._fill(a) or (a == b and bins[a] < 2):
                continue
            for n, g in some[a]:
                if any(n and n + c <= 3 and 0 < g - k <= size - packing._fill(b) for c, k in some[b]):
                    return a, b
    return None


@pytest.mark.parametrize("lengths, pieces", [((250, 500), 4000), ((200, 600), 300), ((1, 1025), 2000), ((340, 700), 300)])
def test_search_ends_only_when_no_exchange_improves(lengths, pieces):
    rng = random.Random(5)
    counts = Counter(rng.randrange(*lengths) for _ in range(pieces))
    bins = packing.local_search(packing.best_fit(counts))
    used = Counter()
    for pattern, n in bins.items():
        assert n > 0 and packing._fill(pattern) <= 1024
        for s, k in pattern:
            used[s] += k * n
    assert used == counts
    least = -(-sum(s * n for s, n in counts.items()) // 1024)
    assert bins.total() == least or improving(bins) is None


def test_best_fit_is_the_plain_algorithm():
    rng = random.Random(4)
    for _ in range(30):
        counts = Counter(rng.randrange(1, 1025) for _ in range(200))
        rooms: list[int] = []
        for s in sorted(counts.elements(), reverse=True):
            fits = [r for r in rooms if r >= s]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else 1024) - s)
        assert packing.best_fit(counts).total() == len(rooms)


def test_no_rows_null_and_repeated_ids(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), *vocabulary()).count() == 0
    rows = packing.pack(spark.createDataFrame([(None, "a"), (3, "a"), (3, "a")], schema), *vocabulary()).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "None"] and {r.length for r in rows} == {2}
