"""The registered queries over whole small tables, against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__
import corpus_pipeline
from tests.llm.test_simhash import brute_components, brute_fingerprint
from tests.llm.test_substrings import brute as brute_repeats
from tracewell.llm import common, fingerprint, queries
from tracewell.llm.common import key_mod

N = 240


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory) -> str:
    rng = random.Random(8)
    sets = {"en": "the of and to thing reo onth", "de": "der die und schön zu keit", "fr": "le la été où tion"}
    passage = " ".join(rng.choices(sets["en"].split(), k=140))
    docs, labels = [], []
    for k in range(N):
        lang = rng.choice(sorted(sets))
        words = ["".join(rng.choices(sets[lang].split(), k=2)) for _ in range(rng.randrange(8, 90))]
        good = rng.random() < 0.75
        text = " ".join(words) if good else " ".join(w + "%%%" for w in words)
        if k % 9 == 0:
            text += " " + passage
        if k % 17 == 3:
            text = docs[k - 2][1]
        docs.append((k, text, lang if k % 11 else None, f"src{k % 3}", len(text)))
        if k % 2 == 0 and k % 17 != 3:
            labels.append((k, int(good), 0))
    root = tmp_path_factory.mktemp("sf")

    def write(name: str, columns: list[str], rows: list[tuple], kinds: list) -> None:
        table = {c: pa.array([r[i] for r in rows], t) for i, (c, t) in enumerate(zip(columns, kinds, strict=True))}
        pq.write_table(pa.table(table), root / f"{name}.parquet", row_group_size=50)

    i, s = pa.int64(), pa.string()
    write("documents", ["doc_id", "text", "lang", "source", "n_chars"], docs, [i, s, s, s, i])
    write("labels", ["doc_id", "quality", "toxic"], labels, [i, pa.int32(), pa.int32()])
    write("pages", ["page_id", "url", "html"], [(k, f"http://h{k % 5}.x.org/en/{k}", f"<nav>menu {k}</nav><article><p>Body {k} is here</p></article>") for k in range(40)], [i, s, s])
    write("conversations", ["conv_id", "turn", "role", "text"], [(k // 4, k % 4, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(80)], [i, i, s, s])
    vectors = np.random.default_rng(1).standard_normal((60, 16)).astype(np.float32)
    vectors[30:40] = vectors[:10] * 2
    write("embeddings", ["vec_id", "embedding", "label"], [(k, v.tolist(), 0) for k, v in enumerate(vectors)], [i, pa.list_(pa.float32()), pa.int32()])
    return str(root)


def documents(spark, sf_dir) -> dict[int, str]:
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def test_entry_adds_all_queries():
    found = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {q.split("_")[0] for q in found} and "pipeline" in found
    assert set(__spark_entry__.oracle_sql()) <= set(found)


def test_every_row_has_a_result(spark, sf_dir):
    want = {"op1_embeddings": ("vec_id", 60), "op2_langid": ("doc_id", N), "op3_fingerprint": ("doc_id", N), "op6_urlfilter": ("page_id", 40), "op7_html": ("page_id", 40), "op8_quality": ("doc_id", N), "op9_suffix_dedup": ("doc_id", N)}
    for name, (key, n) in want.items():
        rows = queries.QUERIES[name](spark, sf_dir).select(key).collect()
        assert sorted(r[0] for r in rows) == list(range(n)), name


def test_language_and_quality_on_held_out_rows(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op2_langid(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.9
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = queries.op8_quality(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]) > 0.9


def test_groups_match_brute_force(spark, sf_dir):
    texts = documents(spark, sf_dir)
    fps = {k: brute_fingerprint(t) for k, t in texts.items()}
    want = brute_components(list(fps), list(fps.values()))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash(spark, sf_dir).collect()}
    assert got == {k: (f"{fps[k]:016x}", want[k]) for k in fps}


def test_vectors_match_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], np.float64)
    n = np.sqrt((v * v).sum(axis=1))
    links = (v @ v.T / np.outer(n, n) >= 0.9) & ~np.eye(len(v), dtype=bool)
    root = np.arange(len(v))
    for _ in range(len(v)):
        root = np.minimum(root, np.where(links, root[None, :], len(v)).min(axis=1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op1_embeddings(spark, sf_dir).collect()}
    assert got == {k: (int(links[k].sum()), int(root[k]), bool(root[k] == k)) for k in range(len(v))} and links.any()


def test_fingerprints_match_brute_force(spark, sf_dir):
    texts = documents(spark, sf_dir)
    order = sorted(texts)
    for k, r in enumerate(sorted(queries.op3_fingerprint(spark, sf_dir).collect(), key=lambda r: r.doc_id)):
        text, ahead = texts[order[k]], texts[order[(k + 1) % len(order)]]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + ahead[:cut]
        own, other, following = (fingerprint.fingerprints(t)[0] for t in (text, edited, ahead))
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (order[k], len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own.tobytes().hex(), other.tobytes().hex())
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(own, other), fingerprint.likeness(own, following))


def test_packed_pieces_match_the_tokenizer(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.vocabulary()[0])
    ids = {k: [*tokenizer.encode(t, add_special_tokens=False).ids, 2] for k, t in documents(spark, sf_dir).items()}
    rows = queries.op5_packing(spark, sf_dir).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.start, r.length))
        bins[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    for k, found in pieces.items():
        at = 0
        for n, (piece, start, length) in enumerate(sorted(found)):
            assert (piece, start) == (n, at) and (n == 0 or length == 1024)
            at += length
        assert at == len(ids[k])
    assert set(pieces) == set(ids)
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(map(len, ids.values())) // 1024) + 2


def test_removed_strings_match_brute_force(spark, sf_dir):
    texts = documents(spark, sf_dir)
    order = sorted(texts)
    gone = dict(zip(order, brute_repeats([texts[k].encode() for k in order], 400), strict=True))
    for r in queries.op9_suffix_dedup(spark, sf_dir).collect():
        raw, g = texts[r.doc_id].encode(), gone[r.doc_id]
        kept = bytes(c for c, x in zip(raw, g, strict=True) if not x)
        runs = sum(x and (k == 0 or not g[k - 1]) for k, x in enumerate(g))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(raw), sum(g), runs, hashlib.sha256(kept).hexdigest())
    assert any(map(any, gone.values()))


def test_planted_passages_of_over_50_words_are_told_beside_the_strings_of_400_bytes(spark, tmp_path):
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choices("abdefgéilmnorstu", k=5)) for _ in range(n))
    passages = [words(52) for _ in range(4)]
    assert all(200 < len(p.encode()) < 400 for p in passages)
    clean = {k: words(rng.randrange(1, 90)) for k in range(20)}
    planted = {20 + k: (words(30), passages[k % 4], words(k)) for k in range(12)}
    texts = clean | {k: f"{a} {b} {c}" for k, (a, b, c) in planted.items()} | {32: "", 33: words(9) + passages[0][:150]}
    rows = [*texts.items(), (34, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op9_suffix_dedup(spark, str(tmp_path)).collect()}
    assert len(got) == 35 and {r.n_removed for r in got.values()} == {0}
    gone = dict(zip(texts, brute_repeats([t.encode() for t in texts.values()], queries.PASSAGE), strict=True))
    for k, (a, b, c) in planted.items():
        r = got[k]
        assert b not in r.text_without_passages and r.text == texts[k]
        assert r.text_without_passages.startswith(a[:-20]) and r.text_without_passages.endswith(c[20:])
        assert r.n_passages == 1 and len(b.encode()) <= r.n_passage_bytes <= sum(gone[k]) <= r.n_passage_bytes + 2
        assert r.n_passage_bytes == len(r.text.encode()) - len(r.text_without_passages.encode())
    for k in [*clean, 32, 33]:
        assert (got[k].n_passage_bytes, got[k].n_passages, got[k].text_without_passages) == (0, 0, texts[k])
    assert (got[34].n_bytes, got[34].n_passage_bytes, got[34].text_without_passages) == (0, 0, "")


def test_stages_keep_columns_with_clashing_names_nulls_and_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).selectExpr(
        "if(doc_id = 5, null, doc_id) doc_id", "if(doc_id in (5, 6), null, if(doc_id = 7, '', text)) text", "lang", "if(doc_id = 8, null, source) source", "n_chars",
        "'x' score", "1 a", "2 b", "3 spans", "'m' mix_topic", "4 fp", "5 row", "6 length", "7 id",
    )
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert {r.score for r in out.collect()} == {"x"}, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
    packed = corpus_pipeline.packing_stage(spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == 60
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), sf_dir).count() == 0


def test_pages_give_their_articles(spark, sf_dir):
    assert {r.page_id: r.text for r in queries.op7_html(spark, sf_dir).collect()} == {k: f"Body {k} is here" for k in range(40)}


def test_each_stage_of_the_pipeline_matches_brute_force(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "best-fit packing"]
    first = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held", key_mod("doc_id", 5) == 0).drop("held")
    kept = corpus_pipeline.quality_stage(spark, first, sf_dir).cache()
    predicted = {r.doc_id for r in queries.op8_quality(spark, sf_dir).where("predicted = 1").collect()}
    assert kept.columns == first.columns and {r.doc_id for r in kept.collect()} == predicted

    one = corpus_pipeline.simhash_stage(spark, kept, sf_dir).cache()
    texts = {r.doc_id: r.text for r in kept.collect()}
    want = brute_components(list(texts), [brute_fingerprint(t) for t in texts.values()])
    assert one.columns == first.columns and sorted(r.doc_id for r in one.collect()) == sorted(set(want.values()))

    cut = corpus_pipeline.repeats_stage(spark, one, sf_dir).cache()
    rows = sorted(one.collect(), key=lambda r: r.doc_id)
    gone = brute_repeats([r.text.encode() for r in rows], corpus_pipeline.PASSAGE)
    got = {r.doc_id: (r.text, r.n_chars) for r in cut.collect()}
    for r, g in zip(rows, gone, strict=True):
        text, at = "", 0
        for c in r.text:
            n = len(c.encode())
            text += "" if all(g[at : at + n]) else c
            at += n
        assert got[r.doc_id] == (text, len(text))
    assert cut.columns == first.columns and any(map(any, gone))

    mixed = corpus_pipeline.mixing_stage(spark, cut, sf_dir).cache()
    ids = {r.doc_id for r in mixed.collect()}
    assert mixed.columns == first.columns and ids < {r.doc_id for r in cut.collect()} and ids

    bins, whole = defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.packing_stage(spark, mixed, sf_dir).collect():
        bins[r.sequence_id] += r.length
        whole[r.doc_id] += r.length
    assert set(whole) == ids and max(bins.values()) <= 1024
    assert sum(whole.values()) == sum(corpus_pipeline.run(spark, sf_dir).agg({"length": "sum"}).first())


def test_the_pipeline_leaves_its_result_and_no_other_table(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    rows = corpus_pipeline.run(spark, sf_dir).count()
    assert rows and [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["best"]
