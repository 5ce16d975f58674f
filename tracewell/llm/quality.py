"""Quality classifier: supervised embeddings of hashed word and character n-grams.

Every word, character n-gram of a word and pair of neighbouring words has a learned
vector at its hash; a document is the average of its vectors, and a softmax layer over
that average gives the class.  Training is stochastic gradient descent in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, discard, materialize, raw_texts, small_batches

MEMO_WORDS = 200_000


@dataclass(frozen=True)
class Params:
    """``rows_per_class`` and ``row_chars`` bound the training sample: of each class, that
    many different labelled rows with the least hash of key and text, of the keys with the least
    hash, among rows of at most so many characters.  ``buckets`` bounds what one row of it can weigh,
    and ``features`` what all do: rows are taken in order of their hash until it is reached (eight bytes each on the driver)."""

    buckets: int = 1 << 16
    dim: int = 16
    sizes: tuple[int, ...] = (2, 3, 4)
    rows_per_class: int = 2000
    row_chars: int = 50_000
    features: int = 20_000_000
    epochs: int = 6
    rate: float = 0.5
    seed: int = 1


@dataclass(frozen=True)
class Model:
    #: What each bucket adds to the logit of class 1; the softmax of two classes needs only that.
    weight: np.ndarray
    bias: float
    params: Params


#: Bucket of a word beside itself, one feature for all words.
ECHO = 0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _buckets(hashes: np.ndarray, p: Params) -> np.ndarray:
    mixed = hashes * _MIX
    return 1 + ((mixed ^ (mixed >> np.uint64(31))) >> np.uint64(7)).astype(np.int64) % (p.buckets - 1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.uint64, len(words))


def word_features(words: list[bytes], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their character n-grams, and the number of the word of each.

    A word's ends count as a space.  All words are hashed together in a few array steps.
    """
    codes = np.frombuffer((b" " + b" ".join(words) + b" ").decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
    gap = codes == 32
    word = np.cumsum(gap) - 1
    found, of = [_buckets(word_hashes(words), p)], [np.arange(len(words))]
    for n in p.sizes:
        count = len(codes) - n + 1
        if count < 1:
            continue
        inner = np.zeros(count, bool)
        h = np.full(count, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : k + count]
            if 0 < k < n - 1:
                inner |= gap[k : k + count]
        ok = ~inner & ((n > 2) | ~(gap[:count] & gap[n - 1 :])) & (word[:count] < len(words))
        found.append(_buckets(h[ok], p))
        of.append(word[:count][ok])
    return np.concatenate(found), np.concatenate(of)


def pair_buckets(first: np.ndarray, second: np.ndarray, p: Params) -> np.ndarray:
    """Buckets of neighbouring words by their hashes."""
    return np.where(first == second, ECHO, _buckets(first * np.uint64(31) + second, p))


def bag(raw: bytes, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and how often each occurs."""
    words = raw.split()
    if not words:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    at = np.array([number[w] for w in words])
    features, of = word_features(list(number), p)
    hashes = word_hashes(list(number))[at]
    sums = np.bincount(features, weights=np.bincount(at)[of], minlength=p.buckets)
    sums += np.bincount(pair_buckets(hashes[:-1], hashes[1:], p), minlength=p.buckets)
    ids = np.flatnonzero(sums)
    return ids.astype(np.int32), sums[ids].astype(np.int32)


class Scorer:
    """Scores texts in batches; what a worker has learned of a word serves all its texts."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.sums, self.sizes, self.hashes = np.empty(0), np.empty(0), np.empty(0, np.uint64)

    def score(self, raws: list[bytes]) -> np.ndarray:
        m = self.model
        if len(self.number) > MEMO_WORDS:
            self.forget()
        split = [raw.split() for raw in raws]
        number = self.number
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in number]
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            features, of = word_features(new, m.params)
            self.sums = np.append(self.sums, np.bincount(of, weights=m.weight[features], minlength=len(new)))
            self.sizes = np.append(self.sizes, np.bincount(of, minlength=len(new)))
            self.hashes = np.append(self.hashes, word_hashes(new))
        lengths = np.array([len(x) for x in split])
        at = np.fromiter((number[w] for w in chain.from_iterable(split)), np.int64, int(lengths.sum()))
        doc = np.repeat(np.arange(len(raws)), lengths)
        total = np.bincount(doc, weights=self.sums[at], minlength=len(raws))
        size = np.bincount(doc, weights=self.sizes[at], minlength=len(raws))
        same = np.flatnonzero(doc[1:] == doc[:-1])
        pairs = pair_buckets(self.hashes[at[same]], self.hashes[at[same + 1]], m.params)
        total += np.bincount(doc[same], weights=m.weight[pairs], minlength=len(raws))
        size += np.bincount(doc[same], minlength=len(raws))
        logit = m.bias + np.divide(total, size, out=np.zeros(len(raws)), where=size > 0)
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, p: Params = Params()) -> Model:
    """Train on a bounded sample of the rows whose label is 0 or 1.

    The sample is chosen by hashes of key and text, so it is the same however the rows are
    dealt out, and rows that repeat both count once.  Null texts count as empty.  Classes are drawn evenly and the bias is set back to their true shares,
    so a score is a probability under the labels' own mix.  With one class or none the
    score is that class's share everywhere (0.5 without labels).
    """
    rows = docs.where(F.col(label_col).isin(0, 1)).select(
        F.col(label_col).cast("int").alias("label"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    shares = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        total = sum(shares.values())
        share = (shares.get(1, 0) + 0.5) / (total + 1)
        return Model(np.zeros(p.buckets, np.float32), float(np.log(share / (1 - share))), p)
    fits = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= p.row_chars)
    classes = sorted(shares)
    keys = None
    for label in classes:  # keys first, so that no text is moved for rows that are not chosen
        some = fits.where(F.col("label") == label).select(F.xxhash64("id").alias("h"), "id").distinct().orderBy("h", "id").limit(p.rows_per_class)
        keys = some if keys is None else keys.unionByName(some)
    some = keys.select(F.col("id").alias("_key")).distinct()
    chosen = fits.join(F.broadcast(some), F.col("id").eqNullSafe(F.col("_key")), "left_semi").withColumn("h", F.xxhash64("id", "text"))
    marks = materialize(chosen.select("label", "h").distinct(), "sample-marks")
    few = []
    for label in classes:  # a key may have many rows: of each class the greatest hash that is in the sample
        last = marks.where(F.col("label") == label).orderBy("h").limit(p.rows_per_class).agg(F.max("h").alias("h")).first()["h"]
        few += [] if last is None else [F.when(F.col("label") == label, F.col("h") <= last)]
    discard(marks)
    picked = chosen.where(F.coalesce(*few) if len(few) == 2 else F.lit(False)).dropDuplicates(["label", "h"])

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag(x, p) for x in raw_texts(batch.column(2))]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], kind)],
                ["h", "ids", "times"],
            ).append_column("label", batch.column(1))

    small_batches(docs.sparkSession)
    bagged = materialize(picked.select("h", "label", "text").mapInArrow(bags, "h long, ids array<int>, times array<int>, label int"), "sample")
    sizes = bagged.select("h", "label", F.size("ids").alias("n")).toArrow().sort_by([("h", "ascending"), ("label", "ascending")])
    within = int((np.cumsum(sizes["n"].to_numpy()) <= p.features).sum())
    if within < sizes.num_rows:  # rows in order of their hash, as many as the bound on features lets in
        last = sizes["h"][within].as_py()
        few_rows = bagged.where(F.col("h") < last)
    else:
        few_rows = bagged
    sample = few_rows.toArrow()
    discard(bagged)
    order = np.argsort(sample["h"].to_numpy(), kind="stable")
    ids, times = (_lists(sample[c], order) for c in ("ids", "times"))
    label = sample["label"].to_numpy()[order]
    weight, bias = _descend(ids, times, label, p)
    del sample, ids, times
    pa.default_memory_pool().release_unused()
    balance = np.log(max(1, (label == 1).sum()) / max(1, (label == 0).sum()))
    return Model(weight, float(bias + np.log(shares[1] / shares[0]) - balance), p)


def _lists(column: pa.ChunkedArray, order: np.ndarray) -> list[np.ndarray]:
    """The lists of a column in an order, as views of its buffers."""
    found = []
    for chunk in column.chunks:
        values, ends = chunk.values.to_numpy(), chunk.offsets.to_numpy()
        found += [values[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return [found[k] for k in order]


def _descend(ids: list, times: list, label: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    rng = np.random.default_rng(p.seed)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (p.buckets, p.dim))
    out, bias = np.zeros((p.dim, 2)), np.zeros(2)
    steps, done = p.epochs * len(ids), 0
    for _ in range(p.epochs):
        for k in rng.permutation(len(ids)):
            rate = p.rate * (1 - done / steps)
            done += 1
            if not len(ids[k]):
                continue
            share = (times[k] / times[k].sum())[:, None]
            mean = (vectors[ids[k]] * share).sum(axis=0)
            logit = mean @ out + bias
            prob = np.exp(logit - logit.max())
            prob /= prob.sum()
            prob[label[k]] -= 1
            back = out @ prob
            out -= rate * np.outer(mean, prob)
            bias -= rate * prob
            vectors[ids[k]] -= rate * len(ids[k]) ** 0.5 * share * back
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def score(
    docs: DataFrame, model: Model, text_col: str = "text", also: tuple[str, ...] = ()
) -> DataFrame:
    """``also`` columns with ``score`` (0 to 1, higher: class 1 likelier) for every row.

    The whole text counts; a null or blank text has no features and gets the score of the
    bias.  Repeated rows get a row each, no rows give no rows, and a column of ``also`` named
    ``score`` gives way.  The model is broadcast: ``buckets`` float32 numbers.
    """
    spark, also = docs.sparkSession, carried(also, ("score",))
    params = model.params
    sent = spark.sparkContext.broadcast((model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value, params))
        for batch in batches:
            raws = raw_texts(batch.column(0))
            scores = [scorer.score(raws[k : k + 128]) for k in range(0, len(raws), 128)]
            scores = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*also, "score"])

    small_batches(spark)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in also]
    return docs.select(F.col(text_col).alias("_text"), *also).mapInArrow(run, ", ".join([*kinds, "score double"]))
