"""Near-duplicate documents by SimHash and a byte-position inverted index.

Two 64-bit fingerprints that differ in at most three bits differ in at most three of
their eight bytes, so they share at least five bytes at equal positions.  Postings are
kept by position and byte value; since any five of the eight positions hold three of
one half, a posting joins the three positional bytes of one of eight triples (four in
each half).  Each pair met in a posting has its shared positional bytes tallied, pairs
that reach the guaranteed five are kept, and the kept ones are verified bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, raw_texts, run_starts, small_batches, split_hot_keys, whole_runs
from .components import connected_components

#: Fixed by the fingerprint: seed and words of a shingle.
SEED, SHINGLE = 42, 3
MAX_BITS = 3
#: Positional bytes that any pair within MAX_BITS shares.
MIN_BYTES = 8 - MAX_BITS
#: Of any five positions three lie in one half: these triples meet every linked pair.
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Distinct fingerprints of one posting that one task compares.
POSTING_CAP = 20_000


def fingerprint(raw: bytes, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, highest bit first, of the SimHash of a UTF-8 text.

    A-Z count as a-z; words are runs of bytes other than ASCII white space; shingles
    count as often as they occur.  A text of fewer words than a shingle is one shingle;
    a text without words gives zero.
    """
    words = raw.lower().split()
    if not words:
        return bytes(8)
    if len(words) <= shingle:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    digest, join = xxhash.xxh64_digest, b" ".join
    total, set_bits = len(words) - shingle + 1, np.zeros(64, np.int64)
    for at in range(0, total, 1 << 16):
        part = words[at : at + (1 << 16) + shingle - 1]
        hashes = b"".join([digest(join(s), SEED) for s in zip(*(part[i:] for i in range(shingle)))])
        set_bits += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > total).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp long)`` of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = b"".join(map(fingerprint, raw_texts(batch.column(1))))
            fp = np.frombuffer(fps, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["id", "fp"])

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, fp long"
    )


def _postings(classes: DataFrame) -> DataFrame:
    def byte(p: int) -> F.Column:
        return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255).cast("long"))

    keys = [
        F.lit(k << 24).cast("long") + byte(a) * (1 << 16) + byte(b) * (1 << 8) + byte(c)
        for k, (a, b, c) in enumerate(TRIPLES)
    ]
    return classes.select("fp", F.explode(F.array(*keys)).alias("posting"))


def _linked(x: np.ndarray) -> np.ndarray:
    """Which XORs of two fingerprints reach the count of shared bytes, then pass bit by bit."""
    tally = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    good = tally >= MIN_BYTES
    good[good] = np.bitwise_count(x[good]) <= MAX_BITS
    return good


def _forest(fp: np.ndarray, block: np.ndarray, cross: bool) -> list[tuple[int, int]]:
    """Edges that connect what the links of one posting connect, by breadth first search:
    fewer edges than fingerprints, however many links there are, in memory of their number."""
    edges, left = [], np.arange(len(fp))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = _linked(fp[left] ^ fp[i])
            if cross:
                near &= block[left] != block[i]
            found = left[near]
            if len(found):
                left = left[~near]
                queue.extend(found)
                edges.extend((i, j) for j in found)
    return edges


def posting_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect each posting's fingerprints, from rows sorted by posting."""
    keys = ["posting", "blk_lo", "blk_hi"]
    for table in whole_runs(batches, keys):
        fp = table["fp"].to_numpy().astype(np.int64).view(np.uint64)
        block, lo, hi = (table[k].to_numpy() for k in ("blk", "blk_lo", "blk_hi"))
        starts = run_starts(table, keys)
        sizes = np.diff(np.append(starts, len(fp)))
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        run_of = np.repeat(np.arange(len(starts)), sizes)
        small = sizes[run_of] <= 16
        for step in range(1, 16):  # every pair of a small posting, all postings at once
            i = np.flatnonzero(small[: len(fp) - step] & (run_of[: len(fp) - step] == run_of[step:]))
            if not len(i):
                break
            i = i[_linked(fp[i] ^ fp[i + step]) & ((lo[i] == hi[i]) | (block[i] != block[i + step]))]
            a.append(i)
            b.append(i + step)
        for k in np.flatnonzero(sizes > 16):
            at = slice(starts[k], starts[k] + sizes[k])
            found = _forest(fp[at], block[at], bool(lo[starts[k]] != hi[starts[k]]))
            if found:
                pairs = np.array(found, np.int64) + starts[k]
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        i, j = (fp[np.concatenate(x)].view(np.int64) for x in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` for every row of ``docs``.

    Rows of equal fingerprint are one class; classes within three bits are linked, and
    ``component_id`` is the smallest id reachable over links, the row's own included.
    Null texts count as empty and, with all other texts without words, share the
    fingerprint zero.  Repeated ids keep a row each.  A null id never names a component
    unless all ids of it are null.  No rows give no rows; other columns are not read.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "simhash")
    classes = fps.groupBy("fp").agg(F.min("id").alias("least"))
    postings = split_hot_keys(_postings(classes), ["posting"], "fp", POSTING_CAP)
    keys = ["posting", "blk_lo", "blk_hi"]
    links = (
        postings.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(posting_links, "a long, b long").distinct()
    )
    roots = connected_components(links).select(F.col("node").alias("fp"), "component")
    joined = classes.join(roots, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = materialize(joined, "simhash-classes")
    names = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(names, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("id", "fp", "component_id")


def keep_one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id names their group; columns as in ``docs``.

    Of rows that repeat such an id the one with the least text stays (null first; of equal
    texts the one with the least hash of the whole row).  A null id stays only where it is alone in
    its group, or all ids of the group are null.
    """
    groups = materialize(simhash_groups(docs, id_col, text_col), "simhash-groups")
    missing = F.lit(-(1 << 63))
    named = groups.where(F.col("id").eqNullSafe(F.col("component_id")))
    keep = named.select(F.coalesce("id", missing).alias("_keep_id")).distinct()
    kept = docs.withColumn("_keep_id", F.coalesce(F.col(id_col).cast("long"), missing)).join(keep, "_keep_id", "left_semi")
    if named.groupBy("id").count().where("count > 1").head(1):
        row = F.struct(*docs.columns)
        first = F.min_by(row, F.struct(F.col(text_col), F.xxhash64(F.to_json(row))))
        kept = kept.groupBy("_keep_id").agg(first.alias("row")).select("row.*")
    return kept.select(*docs.columns)
