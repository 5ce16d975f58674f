"""Removal of long byte strings that occur more than once anywhere in a corpus.

Sorting every suffix of a large corpus would move it many times over.  Instead, each
window of a given length is represented by its anchor: the start of the window's gram (a
shorter string) of least hash, leftmost of equals.  Equal windows have equal anchors at
equal places, so only suffixes at anchors (about one in 170 bytes for windows of 400) can
matter, and of these only the ones whose gram occurs again.  Where all occurrences of a gram
lie in equal surroundings, a count decides.  Where surroundings differ, the text to the right
and, backwards, to the left of one anchor for each kind of surroundings is sorted by
deep-shallow sorting; common prefixes with neighbours in both orders tell which windows are
equal.

A gram with more kinds of surroundings than one task should sort is split without pairing its
rows.  The windows around an anchor are told apart by how far they begin to the left of it;
those that begin between ``lo`` and ``hi`` bytes to the left all hold the ``lo`` bytes left
of the anchor and the ``length - hi`` bytes right of it, so kinds can share one of them only
if they agree there.  Such a core is the key of a smaller group.  What all kinds of a group
share right and left of the anchor, by the least and the greatest in both orders, settles the
windows inside of it at once; the ranges before and behind go on with longer cores, or halves
of the range where nothing is settled.  Kinds that agree in all that the windows of a range
hold need no sort, and one of them goes on for the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, raw_texts, small_batches, whole_runs
from .suffix import common_prefix, deep_shallow_sort

#: Bytes of a text looked at together, and kinds of surroundings sorted as one group.
CHUNK, GRAM_CAP = 1 << 20, 8192


@dataclass(frozen=True)
class Widths:
    """Bytes of the windows that count as repeated, of grams, and the places of a gram in a
    window, which is one more than the most that lies left of an anchor in one."""

    length: int = 400

    @property
    def gram(self) -> int:
        return max(1, min(64, self.length // 4))

    @property
    def span(self) -> int:
        return self.length - self.gram + 1


STEP = 0x9E3779B97F4A7C15
BACK = pow(STEP, -1, 1 << 64)
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * np.uint64(pow(base, done, 1 << 64))
        done += k
    return out


class Hasher:
    """Hashes of slices of byte strings from sums over prefixes, modulo 2^64."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(STEP, max(n, 1 << 14)), _powers(BACK, max(n, 1 << 14))
        out = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: n - 1], out=out[1:])
        return out

    def slices(self, sums: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        h = (sums[end] - sums[start]) * self.down[: len(sums)][start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def anchors(raw: bytes, hasher: Hasher, w: Widths = Widths()) -> tuple[np.ndarray, ...]:
    """Anchors of all windows: places, bytes of surroundings to the left and from there to
    the right, hash of the gram, hash of the surroundings."""
    length, gram, span = w.length, w.gram, w.span
    found = []
    for at in range(0, max(0, len(raw) - length + 1), CHUNK):
        # windows that start in this chunk, and surroundings of their anchors
        low, high = max(0, at - length), min(len(raw), at + CHUNK + 3 * length)
        data = np.frombuffer(raw[low:high], np.uint8)
        sums = hasher.sums(data)
        first = at - low
        windows = min(CHUNK, len(raw) - length + 1 - at)
        grams = windows + span - 1
        h = hasher.slices(sums, slice(first, first + grams), slice(first + gram, first + gram + grams))
        least, width = (h & ~_PLACE) | np.arange(grams, dtype=np.uint64), 1
        while 2 * width <= span:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        least = np.minimum(least[:windows], least[span - width : span - width + windows])
        place = (least & _PLACE).astype(np.int64)
        place = place[np.concatenate([[True], place[1:] != place[:-1]])]
        here = place + at
        left, right = np.minimum(here, span - 1), np.minimum(len(raw) - here, length)
        around = hasher.slices(sums, here - left - low, here + right - low)
        around = (around + left.astype(np.uint64)) * np.uint64(STEP) + right.astype(np.uint64)
        found.append((here, left, right, h[place], around))
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    columns = [np.concatenate(x) for x in zip(*found, strict=True)]
    _, first = np.unique(columns[0], return_index=True)  # windows of two chunks may share an anchor
    return tuple(x[first] for x in columns)


def merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint (low, high) spans; touching ones are joined."""
    if not len(spans):
        return np.empty((0, 2), np.int64)
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]], axis=1)


def find_anchors(w: Widths) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from texts (a, b, text) to their anchors, one row for equal surroundings in
    one text.

    Where surroundings repeat within a text (``times`` > 1), what they cover is known to
    repeat; it is given as rows without hashes, ``pos`` to ``pos + rightward``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            parts: list[list] = [[] for _ in range(7)]
            for k, raw in enumerate(raw_texts(batch.column(2))):
                pos, left, right, h, g = anchors(raw, hasher, w)
                if not len(pos):
                    continue
                order = np.lexsort((pos, g, h))
                new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])])
                times = np.diff(np.append(np.flatnonzero(new), len(pos)))
                one = order[new]
                rows = [pos[one], left[one], right[one], h[one].view(np.int64), g[one].view(np.int64), times]
                again = np.zeros(len(pos), bool)
                again[order] = np.repeat(times > 1, times)
                again &= left + right >= w.length
                zones = merged(np.stack([pos - left, pos + right], axis=1)[again])
                zero = np.zeros(len(zones), np.int64)
                rows = [np.concatenate(x) for x in zip(rows, [zones[:, 0], zero, zones[:, 1] - zones[:, 0], zero, zero, zero], strict=True)]
                for part, x in zip(parts, [np.full(len(rows[0]), k), *rows], strict=True):
                    part.append(x)
            columns = [np.concatenate(p) if p else np.empty(0, np.int64) for p in parts]
            doc = pa.array(columns[0])
            arrays = [batch.column(0).take(doc), batch.column(1).take(doc)]
            arrays += [pa.array(x.astype(np.int32)) for x in columns[1:4]] + [pa.array(x) for x in columns[4:6]] + [pa.array(columns[6].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, ["a", "b", "pos", "leftward", "rightward", "h", "g", "times"])

    return run


ANCHOR = "a long, b long, pos int, leftward int, rightward int, h long, g long, times int"


def repeated_windows(leftward: list[bytes], rightward: list[bytes], group: np.ndarray, low: np.ndarray, high: np.ndarray, w: Widths) -> tuple[np.ndarray, ...]:
    """For anchors with the bytes to the left, backwards, and from there to the right, sorted by
    group: runs of offsets, between a group's
    ``low`` and ``high``, at which the window around an anchor equals another's of its group, as
    (row, low, high) of what the run covers, relative to the anchor."""
    n = len(leftward)
    left, right = (np.array([len(t) for t in side], np.int64) for side in (leftward, rightward))
    right_order, right_shared = deep_shallow_sort(rightward, group, w.length)
    left_order, left_shared = deep_shallow_sort(leftward, group, w.span - 1)
    hit = np.zeros((n, w.span + 1), bool)  # the last column stays empty and ends runs
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(int(low.min(initial=w.span)), int(high.max(initial=-1)) + 1):
        a[right_order] = np.cumsum(right_shared < w.length - offset)
        b[left_order] = np.cumsum((left_shared < offset) | (np.diff(group[left_order], prepend=-1) != 0))
        fits = np.flatnonzero((left >= offset) & (right >= w.length - offset) & (low <= offset) & (offset <= high))
        key = a[fits] * (n + 1) + b[fits]
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        again = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(fits) else np.empty(0, bool)
        hit[fits[order[again]], offset] = True
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0)
    row, first = np.nonzero(edge == 1)
    _, end = np.nonzero(edge == -1)
    return row, -(end - 1), w.length - first


#: A group of surroundings to sort: gram, range of windows, and core.
GROUP = ["h", "lo", "hi", "core"]
KIND = "h long, g long, left binary, right binary, lo int, hi int, core long, whole long"
COVER = "h long, g long, low int, high int"


def compare_surroundings(w: Widths) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from rows of GROUP with (g, left, right), sorted by group, to what equal windows
    cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, GROUP, rows=GRAM_CAP):
            columns = [table[k].to_numpy() for k in GROUP]
            new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
            group = np.cumsum(np.concatenate([[0], new]))
            row, low, high = repeated_windows(table["left"].to_pylist(), table["right"].to_pylist(), group, columns[1], columns[2], w)
            h, g = table["h"].to_numpy()[row], table["g"].to_numpy()[row]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(g), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], ["h", "g", "low", "high"]
            )

    return run


def cut_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted) to one row for each wanted anchor, with the bytes to the left of it,
    backwards, and from it to the right."""
    names = ["h", "g", "hot"]
    for batch in batches:
        wanted = batch.column(1)
        flat = wanted.flatten()
        sizes = np.diff(wanted.offsets.to_numpy())
        raws = raw_texts(batch.column(0))
        field = {f.name: flat.field(f.name) for f in flat.type}
        pos, left, right = (field[k].to_numpy() for k in ("pos", "leftward", "rightward"))
        places = list(zip(np.repeat(np.arange(len(raws)), sizes), pos, left, right, strict=True))
        sides = [raws[d][p - x : p][::-1] for d, p, x, _ in places], [raws[d][p : p + y] for d, p, _, y in places]
        yield pa.RecordBatch.from_arrays([*(field[k] for k in names), *(pa.array(x, pa.binary()) for x in sides)], [*names, "left", "right"])


def shared_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of GROUP with the least and greatest sides to GROUP with the bytes that all share."""
    for batch in batches:
        sides = [batch.column(k).to_pylist() for k in range(4, 8)]
        both = [pa.array([common_prefix(a, b) for a, b in zip(sides[k], sides[k + 1], strict=True)], pa.int32()) for k in (0, 2)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], *both], [*GROUP, "all_left", "all_right"])


def narrowed(w: Widths) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function from rows (h, g, left, right, lo, hi, all_left, all_right) to rows of KIND for the
    ranges of lo..hi that are not settled by what all of the group share: the hash of the core
    that all windows of the range hold, and of all that they hold together (0 where the text
    ends before).  A range whose core does not fit is left out."""

    def ranges(lo: int, hi: int, all_left: int, all_right: int) -> list[tuple[int, int]]:
        settled = max(lo, w.length - all_right), min(hi, all_left)
        rest = [(lo, settled[0] - 1), (settled[1] + 1, hi)] if settled[0] <= settled[1] else [(lo, hi)]
        out = []
        for a, b in rest:
            if b - a > (hi - lo) // 2:  # so that a range is at most halved so many times
                out += [(a, (a + b) // 2), ((a + b) // 2 + 1, b)]
            elif a <= b and (a, b) != (lo, hi):
                out.append((a, b))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda a, b: np.uint64(xxhash.xxh3_64_intdigest(a + b)).astype(np.int64)
        for batch in batches:
            found: list[list] = [[] for _ in range(5)]
            columns = [batch.column(k).to_pylist() for k in range(2, 8)]
            for k, (left, right, *span) in enumerate(zip(*columns, strict=True)):
                for a, b in ranges(*span):
                    if len(left) < a or len(right) < w.length - b:
                        continue
                    core = digest(left[:a], right[: w.length - b])
                    fits = len(left) >= b and len(right) >= w.length - a
                    whole = digest(left[:b], right[: w.length - a]) if fits else 0
                    for part, x in zip(found, (k, a, b, core, whole), strict=True):
                        part.append(x)
            at = pa.array(found[0], pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(at) for c in range(4)), *(pa.array(x, k) for x, k in zip(found[1:], kinds, strict=True))],
                ["h", "g", "left", "right", "lo", "hi", "core", "whole"],
            )

    return run


def split_hot_grams(hot: DataFrame, w: Widths) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Groups of at most GRAM_CAP rows to sort, what is covered without sorting, and the tables
    behind both, from rows (h, g, left, right) of hot grams.

    Each round halves the ranges of windows at least, so there are at most as many as the
    logarithm of a window's length.  Sums of rows by key are partial aggregates.
    """
    small, covered, tables = [], [], []
    now = hot.withColumns({"lo": F.lit(0), "hi": F.lit(w.span - 1), "core": F.lit(0).cast("long")})
    kind = "h long, lo int, hi int, core long, all_left int, all_right int"
    while True:
        ends = now.groupBy(*GROUP).agg(F.min("left").alias("a"), F.max("left").alias("b"), F.min("right").alias("c"), F.max("right").alias("d"))
        ends = materialize(ends.mapInArrow(shared_ends, kind), "shared-ends")
        joined = now.join(ends, GROUP)
        first, last = F.greatest("lo", F.lit(w.length) - F.col("all_right")), F.least("hi", "all_left")
        covered.append(materialize(joined.where(first <= last).select("h", "g", (-last).alias("low"), (F.lit(w.length) - first).alias("high")), "covered"))
        rows = joined.select("h", "g", "left", "right", "lo", "hi", "all_left", "all_right").mapInArrow(narrowed(w), KIND)
        rows = materialize(rows, "narrowed")
        discard(now)
        discard(ends)
        large = materialize(rows.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GRAM_CAP).drop("n"), "large-groups")
        small.append(rows.join(large, GROUP, "left_anti"))
        tables += [rows, large]
        if not large.head(1):
            return small, covered, [*tables, *covered]
        kept = materialize(rows.join(large, GROUP), "large-rows")
        same = kept.where("whole != 0").groupBy(*GROUP, "whole").agg(F.count(F.lit(1)).alias("n"), F.min("g").alias("one"))
        same = materialize(same.where("n > 1"), "same-windows")
        known = kept.join(same, [*GROUP, "whole"], "left")
        covered.append(materialize(known.where("n > 1").select("h", "g", (-F.col("hi")).alias("low"), (F.lit(w.length) - F.col("lo")).alias("high")), "covered"))
        now = materialize(known.where("lo < hi and (n is null or g = one)").select("h", "g", "left", "right", "lo", "hi", "core"), "going-on")
        discard(kept)
        discard(same)


def repeated_spans(docs: DataFrame, w: Widths = Widths()) -> DataFrame:
    """For ``docs`` (a, b: key, text): ``(a, b, spans)``, the spans of bytes to remove."""
    small_batches(docs.sparkSession)
    every = materialize(docs.select("a", "b", "text").mapInArrow(find_anchors(w), ANCHOR), "anchors")
    hashed, zones = every.where("times > 0"), every.where("times = 0")
    grams = hashed.groupBy("h").agg(F.sum("times").alias("n"), (F.min("g") != F.max("g")).alias("differ"))
    grams = materialize(grams.where("n > 1").select("h", "differ"), "grams")  # so that a hot gram's join can be split
    again = materialize(hashed.join(grams, "h"), "anchors-again")
    discard(grams)
    alike, mixed = again.where("not differ"), again.where("differ")

    one = F.min(F.struct("a", "b", "pos", "leftward", "rightward")).alias("one")
    kinds = materialize(mixed.groupBy("h", "g").agg(F.sum("times").alias("n"), one), "surroundings")
    hot = materialize(kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > GRAM_CAP).select("h", F.lit(True).alias("hot")), "hot-grams")
    wanted = kinds.select("h", "g", "one.*").join(hot, "h", "left").groupBy("a", "b").agg(
        F.collect_list(F.struct("pos", "leftward", "rightward", "h", "g", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted")
    )
    cut = docs.select("a", "b", "text").join(wanted, ["a", "b"]).select("text", "wanted")
    cut = cut.mapInArrow(cut_surroundings, "h long, g long, hot boolean, left binary, right binary")
    if docs.groupBy("a", "b").count().where("count > 1").head(1):  # rows that repeat give each kind once
        cut = cut.dropDuplicates(["h", "g"])
    groups, covers, tables = [], [], []
    if hot.head(1):
        cut = materialize(cut, "cut")
        groups, covers, tables = split_hot_grams(cut.where("hot").drop("hot"), w)
    none = F.lit(0).cast("long")
    dealt = cut.where("not hot").select("h", F.lit(0).alias("lo"), F.lit(w.span - 1).alias("hi"), none.alias("core"), "g", "left", "right")
    for more in groups:
        dealt = dealt.unionByName(more.select(*dealt.columns))
    found = dealt.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(compare_surroundings(w), COVER)
    for more in covers:
        found = found.unionByName(more)
    known = kinds.where("n > 1").select("h", "g", (-F.col("one.leftward")).alias("low"), F.col("one.rightward").alias("high"))
    covered = materialize(found.unionByName(known).where(F.col("high") - F.col("low") >= w.length).distinct(), "covered")
    for table in (kinds, hot, cut, *tables):
        discard(table)

    spans = [
        zones.select("a", "b", F.col("pos").alias("low"), (F.col("pos") + F.col("rightward")).alias("high")),
        alike.where(F.col("leftward") + F.col("rightward") >= w.length).select(
            "a", "b", (F.col("pos") - F.col("leftward")).alias("low"), (F.col("pos") + F.col("rightward")).alias("high")
        ),
        mixed.join(covered, ["h", "g"]).select("a", "b", (F.col("pos") + F.col("low")).alias("low"), (F.col("pos") + F.col("high")).alias("high")),
    ]
    each = spans[0].unionByName(spans[1]).unionByName(spans[2])
    out = materialize(each.groupBy("a", "b").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")
    for table in (every, again, covered):
        discard(table)
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str, also: tuple[str, ...]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    return docs.select(F.struct(*also).alias("also"), key.alias("a"), F.xxhash64(text).alias("b"), text.alias("text"))


def _spans_of(column: pa.Array) -> list[np.ndarray]:
    flat, offsets = column.flatten(), column.offsets.to_numpy()
    flat = np.stack([flat.field("low").to_numpy(zero_copy_only=False), flat.field("high").to_numpy(zero_copy_only=False)], axis=1).astype(np.int64)
    offsets = offsets - offsets[0] if len(offsets) else offsets
    return [merged(flat[x:y]) for x, y in zip(offsets, offsets[1:], strict=False)]


def _kept(raw: bytes, spans: np.ndarray) -> bytes:
    cuts = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True))


def _whole_characters(raw: bytes, spans: np.ndarray) -> np.ndarray:
    """Spans drawn in to whole characters of UTF-8: one that is covered in part stays."""
    out = []
    for low, high in spans.tolist():
        while low < high and raw[low] & 0xC0 == 0x80:
            low += 1
        while high > low and high < len(raw) and raw[high] & 0xC0 == 0x80:
            high -= 1
        if low < high:
            out.append((low, high))
    return np.array(out, np.int64).reshape(-1, 2)


def _with_spans(docs: DataFrame, id_col: str, text_col: str, also: tuple[str, ...], *lengths: int) -> DataFrame:
    """``also``, text, and a column of spans for each of ``lengths``."""
    keyed = _keyed(docs, id_col, text_col, also)
    names = [f"spans{k}" for k in range(len(lengths))]
    found = [repeated_spans(keyed, Widths(n)).withColumnRenamed("spans", name) for n, name in zip(lengths, names, strict=True)]
    joined = keyed.join(reduce(lambda x, y: x.join(y, ["a", "b"], "full"), found), ["a", "b"], "left")
    none = F.array().cast("array<struct<low:int,high:int>>")
    return joined.select("also", "text", *(F.coalesce(name, none).alias(name) for name in names))


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, passage: int | None = None) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, text)`` for every row of ``docs``.

    A byte goes if a string of ``length`` bytes covers it that also starts anywhere else, in
    the same text or another; all occurrences go, the first too.  ``text`` is what is left,
    with U+FFFD where a character lost some of its bytes.  Null texts count as empty; texts
    shorter than ``length`` lose nothing.  Rows that repeat an id and text are documents of
    their own, so their text repeats.  Other columns are not read.  No rows give no rows.

    ``passage`` adds what strings of so many bytes that occur again would take with them, in
    whole characters: ``(n_passage_bytes, n_passages, text_without_passages)``.  The other
    columns do not depend on it.
    """
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    if passage is not None:
        names += ["n_passage_bytes", "n_passages", "text_without_passages"]
        kinds += [pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws, rows = raw_texts(batch.column(1)), []
            for raw, spans, *more in zip(raws, *map(_spans_of, batch.columns[2:]), strict=True):
                kept = _kept(raw, spans)
                row = [len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")]
                for passages in more:
                    passages = _whole_characters(raw, passages)
                    kept = _kept(raw, passages)
                    row += [len(raw) - len(kept), len(passages), kept.decode("utf-8", "replace")]
                rows.append(row)
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).field(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = ", ".join(f"{name} {'string' if kind == pa.string() else 'long'}" for name, kind in zip(names, [pa.int64(), *kinds], strict=True))
    small_batches(docs.sparkSession)
    lengths = (length,) if passage is None else (length, passage)
    return _with_spans(docs, id_col, text_col, (id_col,), *lengths).mapInArrow(run, schema)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """``docs`` with repeated strings of ``length`` bytes taken out of the text; columns, rows and
    ids as before.

    Only whole characters are taken out, so that the text stays valid.  A null text stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                _kept(raw, _whole_characters(raw, spans))
                for raw, spans in zip(raw_texts(batch.column(1)), _spans_of(batch.column(2)), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], ["also", "kept"])

    others = tuple(c for c in docs.columns if c != text_col)
    flagged = docs.withColumn("_no_text", F.col(text_col).isNull())
    small_batches(docs.sparkSession)
    given = _with_spans(flagged, id_col, text_col, (*others, "_no_text"), length)
    kind = given.schema["also"].dataType.simpleString()
    out = given.mapInArrow(run, f"also {kind}, kept string")
    text = F.when(~F.col("also._no_text"), F.col("kept"))
    return out.select(*(text.alias(c) if c == text_col else F.col(f"also.`{c}`").alias(c) for c in docs.columns))
