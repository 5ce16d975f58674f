"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into the phrases of an LZ78 dictionary: each phrase is the shortest one
that is new.  Texts that compress well together share phrases, so the Jaccard likeness of
phrase sets is a likeness in the sense of compression; minimum hashes estimate it.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw_texts, shuffle_partitions, small_batches

LANES, BITS = 64, 16
_rng = np.random.default_rng(20_240_601)
MULTIPLY = _rng.integers(1 << 63, size=LANES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(1 << 63, size=LANES, dtype=np.uint64)
#: An odd multiplier and its inverse modulo 2^64, for sums over slices of a text.
STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
#: Phrases hashed against all lanes at a time.
CHUNK = 1 << 14
EMPTY = np.full(LANES, np.uint64((1 << 64) - 1))


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, by doubling."""
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return out


def parse(text: str, seen: set[str], phrase: str = "") -> tuple[list[int], str]:
    """Lengths of the new phrases of ``text``, and what is left of the last, unfinished one.

    ``seen`` grows by the phrases; ``phrase`` is what an earlier part left over.
    """
    lengths = []
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            lengths.append(len(phrase))
            phrase = ""
    return lengths, phrase


def phrase_hashes(text: str, lengths: list[int]) -> np.ndarray:
    """A 64-bit hash of each phrase, where the phrases lie one behind the other in ``text``."""
    ends = np.cumsum(np.array(lengths, np.int64))
    used = int(ends[-1]) if len(ends) else 0
    codes = np.frombuffer(text[:used].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((codes + np.uint64(1)) * _powers(STEP, used), dtype=np.uint64)])
    starts = ends - np.array(lengths, np.int64)
    h = (sums[ends] - sums[starts]) * _powers(BACK, used + 1)[starts]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    least = EMPTY.copy()
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK, None] * MULTIPLY + ADD
        np.minimum(least, part.min(axis=0), out=least)
    return least


def signature(least: np.ndarray) -> np.ndarray:
    """16 bits of each lane: two texts agree in a lane by chance once in 65,536."""
    mixed = least * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - BITS)).astype(">u2")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal lanes; two texts without phrases are alike."""
    return float((a == b).mean())


def fingerprints(text: str, ending: str | None = None, keep: int = 0) -> tuple[np.ndarray, np.ndarray | None]:
    """Signatures of ``text`` and of ``text[:keep] + ending``; what both share is parsed once."""
    seen: set[str] = set()
    head, left = parse(text[:keep], seen)
    shared = least_hashes(phrase_hashes(text, head))
    done = sum(head)

    def finish(rest: str, seen: set[str]) -> np.ndarray:
        lengths, _ = parse(rest, seen, left)
        return signature(np.minimum(shared, least_hashes(phrase_hashes(text[done:keep] + rest, lengths))))

    edited = None if ending is None else finish(ending, seen.copy() if keep < len(text) else seen)
    return finish(text[keep:], seen), edited


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in OUT.split(", ")]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and likeness to it and to the next text.

    The edited text is the text with its last ``n_chars // 4`` characters replaced by the
    first as many (or all) of the next document in order of id; after the last comes the
    first, so a single document is followed by itself.  Rows of equal id are ordered by their
    text's hash, then by their text; null ids come first, null texts count as empty.  No rows
    give no rows.

    Documents are sorted in ranges of id and hash, so that an id which very many rows repeat
    is dealt out too.  The first document of each range is also sent, as a guest, to the range
    before, so that every document meets its follower in the task that holds it and each text
    is shuffled once.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    place = F.struct(key.alias("id"), F.xxhash64("text").alias("h"))
    parts = shuffle_partitions(spark)
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = base.agg(F.percentile_approx(key, shares).alias("q")).first()["q"]
    if bounds is None:
        return spark.createDataFrame([], OUT)
    # an id that is several of the bounds has its hashes dealt evenly among as many ranges
    starts = [(x, -(1 << 63) + (k << 64) // n) for x, n in sorted(Counter(bounds).items()) for k in range(n)]
    ranges = F.array(*(F.struct(F.lit(x).alias("id"), F.lit(h).alias("h")) for x, h in starts))
    r = F.size(F.filter(ranges, lambda b: b <= place))
    firsts = [row["first"] for row in base.groupBy(r.alias("r")).agg(F.min(place).alias("first")).orderBy("r").collect()]
    n = len(firsts)
    ranges = F.array(*(F.struct(F.lit(x["id"]).alias("id"), F.lit(x["h"]).alias("h")) for x in firsts))
    r = F.size(F.filter(ranges, lambda b: b <= place)) - 1
    homes = F.array(F.struct(r.alias("r"), F.lit(False).alias("guest")))
    guest = F.array(F.struct(F.pmod(r - 1, F.lit(n)).alias("r"), F.lit(True).alias("guest")))
    dealt = base.withColumn("c", F.explode(F.when(F.array_contains(ranges, place), F.concat(homes, guest)).otherwise(homes)))
    dealt = dealt.select("c.r", "c.guest", "doc_id", "text").repartitionById(n, "r")
    small_batches(spark)
    order = ["r", "guest", F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text"]
    return dealt.sortWithinPartitions(*order).mapInArrow(_rows, OUT)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by range, guests last: each document, but guests, with the one behind it.

    A row is finished once the follower's own signature is known, so each text is parsed once.
    """
    held: tuple | None = None  # range, id and text of the document whose follower comes next
    before: list | None = None  # the row of the document before, with its signature, still without near_next

    for batch in batches:
        out = []

        def close(own: np.ndarray, out: list = out) -> None:
            if before is not None:
                row, last = before
                out.append((*row, likeness(last, own)))

        columns = [batch.column(k).to_pylist() for k in range(3)]
        for r, guest, doc_id, raw in zip(*columns, raw_texts(batch.column(3)), strict=True):
            text = raw.decode("utf-8", "replace")
            if held is not None and held[0] == r:
                own, row = _row(held[1], held[2], text)
                close(own)
                before = [row, own]
                if guest:
                    close(fingerprints(text)[0])
                    before = held = None
            if not guest:
                held = (r, doc_id, text)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 7, KINDS, strict=True)], NAMES)


def _row(doc_id: int, text: str, ahead: str) -> tuple[np.ndarray, tuple]:
    cut = len(text) // 4
    keep = len(text) - cut
    own, other = fingerprints(text, ahead[:cut], keep)
    edited = (text[:keep] + ahead[:cut]).encode("utf-8", "surrogatepass")
    texts = hashlib.sha256(edited).hexdigest(), own.tobytes().hex(), other.tobytes().hex()
    return own, (doc_id, len(text), *texts, likeness(own, other))
