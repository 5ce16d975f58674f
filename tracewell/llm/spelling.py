"""Spelling variants: words that differ by one letter, and the form that each is a variant of.

Letters are dealt into groups of about equal use.  A word's vector counts its letters by
group, and the vectors form a trie, one group to a level.  One inserted letter raises one
count by one (a surplus), one deleted letter lowers one (a deficit), a replaced letter does
both or neither.  So the near words of a word are found by a depth-first search of the trie
that follows the word's own counts and spends one surplus and one deficit at most; the
words at the leaves that it reaches are then compared letter by letter.

Of two near words one has the greater vector in the order of levels, so a search that
spends its surplus before its deficit finds each pair once, from the lesser word.

The first levels of the trie are its cells.  A word is a member of one cell, and asks in
each cell that such a search can reach; Spark brings members and askers of a cell together
and each task searches the subtries of its cells.  More words make more levels cells, and a
cell with very many rows is split into pairs of blocks, so that no task holds a share of
the vocabulary that grows with it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, raw_texts, run_starts, small_batches, split_hot_keys, whole_runs

#: Fixed by the task: runs of these letters are words; only A-Z have lower-case forms here.
LETTERS = "A-Za-zÀ-ÿ"


@dataclass(frozen=True)
class Params:
    """What is a word, what is a variant, and how the search is dealt out."""

    #: Code points that a word has at least, and times that it stands in the texts.
    least_letters: int = 6
    least_count: int = 5
    #: A form has at least so many times the variant's count.
    ratio: int = 5
    #: Letter groups, the levels of the trie.
    groups: int = 16
    #: Words that a cell should hold; decides how many levels are cells.
    cell_words: int = 1 << 14
    #: Rows of a cell (members and askers) beyond which it is split into blocks.
    cell_rows: int = 1 << 17


#: Levels that can be cells at most: a cell's key holds six bits of each count.
MOST_CELL_LEVELS = 10
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 1 << 18
#: Letters of words that are compared in a matrix; longer words are compared one by one.
WIDTH = 40
#: Pairs, and steps of a search, that are looked at in one go.
BLOCK = 1 << 17


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params(), misspell: int | None = None) -> DataFrame:
    """``(word, n)``: the words of whole texts that are long and frequent enough.

    A null text has no words.  With ``misspell``, a run of letters loses one letter where the
    crc32 of ``<id>:<run>`` is a multiple of that number (the letter at crc32 modulo length), which
    plants variants; a null id counts as the empty text.  Rows that repeat an id count each.
    """
    least = p.least_letters
    pattern = f"[{LETTERS}]{{{least},}}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern).findall
        held: Counter = Counter()
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                words = Counter(find(raw.lower().decode("utf-8", "replace")))
                if misspell:
                    start = zlib.crc32(f"{'' if key is None else key}:".encode())
                    for word, n in words.items():
                        h = zlib.crc32(word.encode(), start)
                        if h % misspell == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                        if len(word) >= least:
                            held[word] += n
                else:
                    held.update(words)
                if len(held) >= HELD_WORDS:
                    yield _counted(held)
                    held = Counter()
        if held:
            yield _counted(held)

    small_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    found = found.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= p.least_count)


def _counted(held: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def letter_groups(words: DataFrame, groups: int) -> np.ndarray:
    """Of each of the 256 letters' codes its group: frequent letters first, each to the group
    that has least so far.  What is collected is the alphabet, 90 rows at most."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count()
    load, out = [0] * groups, np.zeros(256, np.int64)
    for row in sorted(letters.collect(), key=lambda r: (-r["count"], r["letter"])):
        group = min(range(groups), key=lambda g: (load[g], g))
        load[group] += row["count"]
        out[ord(row["letter"])] = group
    return out


def cell_levels(n_words: int, p: Params) -> int:
    """Levels that are cells: each about halves what the largest cell holds."""
    levels = 1
    while levels < min(MOST_CELL_LEVELS, p.groups) and n_words > p.cell_words << (levels - 1):
        levels += 1
    return levels


class Words:
    """Words as matrices of letters, from a binary Arrow column (one byte a letter)."""

    def __init__(self, column: pa.Array, group_of: np.ndarray, groups: int):
        self.size = np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]).astype(np.int64)
        first = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column)].astype(np.int64)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
        data = np.append(data, np.zeros(1, np.uint8))
        width = int(min(WIDTH, self.size.max(initial=0)))
        at = np.arange(width)
        inside = at < self.size[:, None]
        self.left = np.where(inside, data[np.where(inside, first[:, None] + at, 0)], 0)
        back = first[:, None] + self.size[:, None] - 1 - at
        self.right = np.where(inside, data[np.where(inside, back, 0)], 0)
        self.long = {int(i): bytes(data[first[i] : first[i] + self.size[i]]) for i in np.flatnonzero(self.size > WIDTH)}
        of = np.where(inside, group_of[self.left], -1)
        self.counts = np.stack([(of == g).sum(axis=1) for g in range(groups)], axis=1).astype(np.int32)
        for i, word in self.long.items():
            self.counts[i] = np.bincount(group_of[np.frombuffer(word, np.uint8)], minlength=groups)

    def differ_by_one(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs differ by exactly one inserted, deleted or replaced letter."""
        short, gap = np.minimum(self.size[a], self.size[b]), np.abs(self.size[a] - self.size[b])
        good = gap <= 1
        for k in np.flatnonzero(good & (short >= WIDTH)) if self.long else ():
            good[k] = _one_apart(self._word(a[k]), self._word(b[k]))
        rest = np.flatnonzero(good & (short < WIDTH))
        if len(rest):
            good[rest] = self._near(a[rest], b[rest], short[rest], gap[rest])
        return good

    def _near(self, a, b, short, gap) -> np.ndarray:
        same = self.left[a] == self.left[b]
        out = np.zeros(len(a), bool)
        equal = gap == 0
        out[equal] = (~same[equal]).sum(axis=1) == 1
        one = np.flatnonzero(~equal)
        if len(one):
            ahead = np.where(same[one].all(axis=1), same.shape[1], same[one].argmin(axis=1))
            tail = self.right[a[one]] == self.right[b[one]]
            behind = np.where(tail.all(axis=1), tail.shape[1], tail.argmin(axis=1))
            out[one] = ahead + behind >= short[one]
        return out

    def _word(self, i: int) -> bytes:
        return self.long.get(int(i)) or self.left[i, : self.size[i]].tobytes()


def _one_apart(a: bytes, b: bytes) -> bool:
    if len(a) > len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(a) == len(b):
        return int((x != y).sum()) == 1
    ahead = np.append(np.flatnonzero(x != y[: len(x)]), len(x))[0]
    return bool((x[ahead:] == y[ahead + 1 :]).all())


class Trie:
    """The distinct rows of a matrix of counts, a level for each column."""

    def __init__(self, counts: np.ndarray):
        n, self.levels = counts.shape
        self.base = int(counts.max(initial=0)) + 3
        self.order = np.lexsort(counts.T[::-1])
        rows = counts[self.order]
        new = np.ones(n, bool)
        new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
        self.start = np.flatnonzero(new)
        self.size = np.diff(np.append(self.start, n))
        self.rows = rows[self.start]
        self.children, above, change = [], np.zeros(len(self.rows), np.int64), np.zeros(len(self.rows), bool)
        change[:1] = True
        for level in range(self.levels):
            change = change.copy()
            change[1:] |= self.rows[1:, level] != self.rows[:-1, level]
            heads = np.flatnonzero(change)
            self.children.append(above[heads] * self.base + self.rows[heads, level] + 1)
            above = np.cumsum(change) - 1

    def child(self, level: int, node: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child of that count, and the children of those."""
        known, want = self.children[level], node * self.base + np.minimum(count, self.base - 2) + 1
        at = np.minimum(np.searchsorted(known, want), len(known) - 1)
        there = (known[at] == want) & (count < self.base - 2) if len(known) else np.zeros(len(node), bool)
        return there, at[there]

    def search(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Depth-first: for the rows of ``asked``, the leaves that one surplus and then one
        deficit at most lead to, as ``(row, leaf, spent)``; spent is 0, 1 (surplus) or 2 (both)."""
        n = len(asked)
        stack = [(0, np.arange(lo, min(n, lo + BLOCK)), np.zeros(min(n, lo + BLOCK) - lo, np.int64), np.zeros(min(n, lo + BLOCK) - lo, np.int8)) for lo in range(0, n, BLOCK)]
        while stack:
            level, row, node, spent = stack.pop()
            if level == self.levels:
                yield row, node, spent
                continue
            want, found = asked[row, level].astype(np.int64), []
            for step, ready in ((0, None), (1, 0), (-1, 1)):
                at = np.arange(len(row)) if ready is None else np.flatnonzero(spent == ready)
                there, below = self.child(level, node[at], want[at] + step)
                at = at[there]
                found.append((row[at], below, spent[at] + (step != 0)))
            row, node, spent = (np.concatenate(x) for x in zip(*found, strict=True))
            for lo in range(0, len(row), BLOCK):
                at = slice(lo, lo + BLOCK)
                stack.append((level + 1, row[at], node[at], spent[at].astype(np.int8)))


def _crossed(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All pairs of places (a .. a + n_a) x (b .. b + n_b) of each row, a bounded number at a time."""
    ends = np.cumsum(n_a * n_b)
    total = int(ends[-1]) if len(ends) else 0
    for lo in range(0, total, BLOCK):
        t = np.arange(lo, min(total, lo + BLOCK))
        k = np.searchsorted(ends, t, "right")
        r = t - (ends[k] - n_a[k] * n_b[k])
        yield k, a[k] + r // n_b[k], b[k] + r % n_b[k]


def near_pairs(words: Words, asks: np.ndarray, block: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of near words in one cell: askers (and, as they ask in their own cell too,
    members) against members.  ``cross``: only rows of different blocks."""
    members = np.flatnonzero(~asks)
    if not len(members):
        return
    trie, askers = Trie(words.counts[members]), Trie(words.counts)
    for row, leaf, spent in trie.search(askers.rows):
        sizes = askers.size[row], trie.size[leaf]
        for k, i, j in _crossed(askers.start[row], sizes[0], trie.start[leaf], sizes[1]):
            a, b = askers.order[i], members[trie.order[j]]
            fit = (spent[k] > 0) | (~asks[a] & (a < b))
            if cross:
                fit &= block[a] != block[b]
            a, b = a[fit], b[fit]
            good = words.differ_by_one(a, b)
            if good.any():
                yield a[good], b[good]


def near_words(words: DataFrame, p: Params = Params()) -> DataFrame:
    """``(word, near, near_n)`` for ``words(word, n)``, distinct: each pair of near words both ways."""
    n_words = words.count()
    group_of, levels, groups = letter_groups(words, p.groups), cell_levels(n_words, p), p.groups

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array([w.encode("latin-1") for w in batch.column(0).to_pylist()], pa.binary())
            counts = Words(raw, group_of, groups).counts[:, :levels].astype(np.int64)
            place = np.int64(1) << (6 * np.arange(levels))
            digit = lambda c: c & 63
            own = (digit(counts) * place).sum(axis=1)
            up = [own + (digit(counts[:, i] + 1) - digit(counts[:, i])) * place[i] for i in range(levels)]
            rows, cells, asks = [np.arange(len(raw))], [own], [np.zeros(len(raw), bool)]
            for i in range(levels):
                rows.append(np.arange(len(raw)))
                cells.append(up[i])
                for j in range(i + 1, levels):
                    some = np.flatnonzero(counts[:, j] > 0)
                    rows.append(some)
                    cells.append(up[i][some] + (digit(counts[some, j] - 1) - digit(counts[some, j])) * place[j])
            at = pa.array(np.concatenate(rows))
            asks.append(np.ones(len(at) - len(raw), bool))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(cells)), pa.array(np.concatenate(asks)), raw.take(at), batch.column(1).take(at)], ["cell", "asks", "word", "n"]
            )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["cell", "blk_lo", "blk_hi"]
        for table in whole_runs(batches, keys, 1 << 12):
            starts = np.append(run_starts(table, keys), table.num_rows)
            for lo, hi in zip(starts[:-1], starts[1:], strict=True):
                part = table.slice(lo, hi - lo).combine_chunks()
                asks = part["asks"].to_numpy(zero_copy_only=False)
                if asks.all() or hi - lo < 2:
                    continue
                raw, n = pa.concat_arrays(part["word"].chunks), part["n"].to_numpy()
                block = part["blk"].to_numpy()
                cross = part["blk_lo"][0] != part["blk_hi"][0]
                text = pa.array([w.decode("latin-1") for w in raw.to_pylist()], pa.string())
                for a, b in near_pairs(Words(raw, group_of, groups), asks, block, cross):
                    to, of = pa.array(np.concatenate([a, b])), np.concatenate([b, a])
                    yield pa.RecordBatch.from_arrays([text.take(to), text.take(pa.array(of)), pa.array(n[of])], ["word", "near", "near_n"])

    small_batches(words.sparkSession, 1 << 14)
    cells = words.select("word", "n").mapInArrow(to_cells, "cell long, asks boolean, word binary, n long")
    dealt = split_hot_keys(materialize(cells, "spelling-cells"), ["cell"], "word", p.cell_rows)
    keys = ["cell", "blk_lo", "blk_hi"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(search, "word string, near string, near_n long")


def variants(words: DataFrame, p: Params = Params()) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for ``words(word, n)``: distinct words of the letters
    of LETTERS, each with its count.

    ``form`` is the near word of largest n (of equals the least in code-point order) where that n is
    at least ``ratio`` times the word's, else null.  ``root`` follows forms to the last; counts grow by
    that ratio at each step, so the rounds of pointer doubling grow with the logarithm of the
    logarithm of the largest count.  A null word is left out, words of other letters raise an error.
    No words give no rows.
    """
    words = materialize(words.where("word is not null"), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best")
    near = near_words(words, p).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    has = -F.col("best.m") >= p.ratio * F.col("n")
    known = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.w")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")
    )
    known = materialize(known, "spelling-near")
    now = materialize(known.where("form is not null").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(now)
        now = after
        if not now.where("moved").head(1):
            break
        now = after.select("word", "root")
        now._tracewell_path = after._tracewell_path
    out = known.join(now.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
