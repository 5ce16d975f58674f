"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, discard, materialize, raw_texts, small_batches

UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")
#: Words that a worker remembers before it starts anew.
MEMO_WORDS = 200_000
#: Languages whose sums a task holds, or the driver reads, at once.
LANGS_AT_ONCE = 64


@dataclass(frozen=True)
class Params:
    """``buckets`` bounds the broadcast matrix: that many float32 numbers for each language,
    128 KB, however much text there is.  It grows with the number of languages only."""

    buckets: int = 1 << 15
    sizes: tuple[int, ...] = (1, 2, 3)
    smoothing: float = 0.5


@dataclass(frozen=True)
class Model:
    langs: list[str]
    #: log P(bucket | lang), buckets x langs
    log_prob: np.ndarray
    log_prior: np.ndarray
    params: Params


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return LETTERS.findall(text.lower())


def buckets_of(words: list[str], p: Params) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character n-grams and the number of the word of each; a word's ends
    count as a space, and what is no letter in it is left out.  All words are hashed together."""
    letters = " ".join([w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in words])
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    gap = codes == 32
    word = np.cumsum(gap) - 1
    found, of = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for n in p.sizes:
        count = len(codes) - n + 1
        if count < 1:
            continue
        h, bad = np.full(count, n, np.uint64), gap[:count] & gap[n - 1 :]
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : k + count]
            if 0 < k < n - 1:
                bad = bad | gap[k : k + count]
        if n > 2:  # a single letter between two ends is a gram
            bad &= ~(gap[:count] & gap[n - 1 :] & ~np.logical_or.reduce([gap[k : k + count] for k in range(1, n - 1)]))
        mixed = h * np.uint64(0x9E3779B97F4A7C15)
        ok = ~bad
        found.append(((mixed[ok] ^ (mixed[ok] >> np.uint64(31))) >> np.uint64(7)).astype(np.int64) % p.buckets)
        of.append(word[:count][ok])
    return np.concatenate(found), np.concatenate(of)


def fit(docs: DataFrame, text_col: str, lang_col: str, p: Params = Params()) -> Model:
    """Count n-grams by language over all rows with a language.

    Each task sums its words by language before it hashes their n-grams, and sends one
    row for each bucket and language it met; Spark adds these.  The driver reads the sums of
    a few languages at a time, at most ``buckets`` for each.  Every language that occurs is
    learned.  Rows without language teach nothing; repeated rows count each time.
    """
    known = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    prior = {r["lang"]: r["docs"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("docs")).collect()}
    langs = sorted(prior)
    number = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, Counter] = defaultdict(Counter)
        held = 0

        def spend() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                at, of = buckets_of(list(words), p)
                times = np.fromiter(words.values(), np.float64, len(words))
                found = np.bincount(at, weights=times[of], minlength=p.buckets).astype(np.int64)
                sums[lang] = sums[lang] + found if lang in sums else found
                if len(sums) >= LANGS_AT_ONCE:
                    yield from rows()
            seen.clear()

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, found in sums.items():
                at = np.flatnonzero(found)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), number[lang], np.int32)), pa.array(at.astype(np.int32)), pa.array(found[at])],
                    ["lang", "bucket", "n"],
                )
            sums.clear()

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                words = seen[lang]
                held -= len(words)
                words.update(words_of(raw.decode("utf-8", "replace")))
                held += len(words)
                if held > MEMO_WORDS:
                    yield from spend()
                    held = 0
        yield from spend()
        yield from rows()

    small_batches(docs.sparkSession)
    counted = known.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "grams")
    log_prob = np.empty((p.buckets, len(langs)), np.float32)
    for first in range(0, len(langs), LANGS_AT_ONCE):
        some = range(first, min(len(langs), first + LANGS_AT_ONCE))
        part = counted.where(F.col("lang").between(some.start, some.stop - 1)).toArrow()
        grams = np.full((p.buckets, len(some)), p.smoothing)
        grams[part["bucket"].to_numpy(), part["lang"].to_numpy() - first] += part["n"].to_numpy()
        log_prob[:, some] = np.log(grams / grams.sum(axis=0, keepdims=True))
    discard(counted)
    docs_of = np.array([prior[x] for x in langs], float)
    return Model(langs, log_prob, np.log(docs_of / docs_of.sum()) if langs else docs_of, p)


class Words:
    """Words that a worker has met, by number, with the sums of their n-grams' rows of the
    matrix; the last column tells whether a word has letters."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.rows = np.zeros((0, len(self.model.langs) + 1), np.float32)

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the texts' words one behind the other, and how many each text has."""
        if len(self.number) > MEMO_WORDS:
            self.forget()
        number, split = self.number, [words_of(t) for t in texts]
        new = [w for w in dict.fromkeys(chain.from_iterable(split)) if w not in number]
        if new:
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            at, of = buckets_of(new, self.model.params)
            table = self.model.log_prob
            columns = [np.bincount(of, weights=table[at, k], minlength=len(new)) for k in range(table.shape[1])]
            columns.append(np.bincount(of, minlength=len(new)) > 0)
            self.rows = np.concatenate([self.rows, np.stack(columns, axis=1).astype(np.float32)])
        sizes = np.array([len(x) for x in split])
        return np.fromiter((number[w] for w in chain.from_iterable(split)), np.int64, int(sizes.sum())), sizes


def score_batch(texts: list[str], words: Words) -> tuple[list[str], np.ndarray]:
    """Languages and posteriors: rows of the words' numbers summed by document in one pass."""
    model = words.model
    flat, sizes = words.numbers(texts)
    sums = np.zeros((len(texts), len(model.langs) + 1))
    some = np.flatnonzero(sizes)
    if len(some):
        starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
        sums[some] = np.add.reduceat(words.rows[flat], starts, axis=0, dtype=np.float64)
    score = sums[:, :-1] + model.log_prior
    langs, probs = [], np.zeros(len(texts))
    for k in range(len(texts)):
        if not sums[k, -1] or not model.langs:
            langs.append(UNKNOWN)
            continue
        best = int(np.argmax(score[k]))
        probs[k] = 1 / np.exp(score[k] - score[k, best]).sum()
        langs.append(model.langs[best])
    return langs, probs


def identify(docs: DataFrame, model: Model, text_col: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``also`` columns with ``lang_pred`` and ``score`` (posterior, 0 to 1) for every row.

    The whole text counts.  A null text, a text without letters, or a model that has seen
    no language gives ``und`` with score 0.  Equal posteriors go to the language that sorts
    first.  Repeated rows get a row each, no rows give no rows, and columns of ``also`` named
    like the two give way.  The model is broadcast; :class:`Params` tells its size.
    """
    spark, also = docs.sparkSession, carried(also, ("lang_pred", "score"))
    params = model.params
    sent = spark.sparkContext.broadcast((model.langs, model.log_prob, model.log_prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value, params)
        words = Words(m)
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in raw_texts(batch.column(0))]
            langs, probs = [], []
            for at in range(0, len(texts), 128):
                some, p = score_batch(texts[at : at + 128], words)
                langs += some
                probs.append(p)
            out = [*batch.columns[1:], pa.array(langs, pa.string()), pa.array(np.concatenate(probs) if probs else np.empty(0))]
            yield pa.RecordBatch.from_arrays(out, [*also, "lang_pred", "score"])

    small_batches(spark)
    kinds = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in also]
    return docs.select(F.col(text_col).alias("_text"), *also).mapInArrow(
        run, ", ".join([*kinds, "lang_pred string", "score double"])
    )
