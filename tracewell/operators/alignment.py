"""Order-keeping comparison of logs: which lines of one stand, in order, in the other.

Patience alignment.  Between two aligned lines lies a gap, at first the whole file.  In each
round equal lines at a gap's two edges are aligned; of the lines whose text stands just once on
either side of the gap, the longest sequence that rises on both sides is aligned, which makes
smaller gaps.  Where no text of a gap stands once, its n-th occurrences on either side take that
place.  Rounds end when no gap holds a text of both sides.

The longest rising sequence is cut where all that stands before on one side also stands before
on the other, and lines that are neighbours on both sides stay together, so what one task
looks at are the runs of lines that have changed places with each other, not a file.  Gaps of
a few lines are aligned by the same rules in one task each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import store
from .ordered import CHUNK, Scan

GAP = ["file", "g"]
#: Lines of both sides up to which a gap is aligned in one task.
SMALL = 4096


def rising(places: list[int], weights: list[int]) -> list[int]:
    """Which of some runs, at different places, make the heaviest rising sequence; of equally heavy
    ones the sequence whose runs, from its end, have the lowest places."""
    tops: list[int] = []
    best: list[tuple[int, int]] = []  # weight up to the top and its run: heavier with each top
    back = [-1] * len(places)
    for k, (place, weight) in enumerate(zip(places, weights, strict=True)):
        at = bisect_left(tops, place)
        if at:
            weight, back[k] = weight + best[at - 1][0], best[at - 1][1]
        if at and best[at - 1][0] >= weight:
            continue
        end = at
        while end < len(tops) and best[end][0] <= weight:
            end += 1
        tops[at:end] = [place]
        best[at:end] = [(weight, k)]
    out, k = [], best[-1][1] if best else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def _rising_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, g, block, run, place, size) sorted by block: the runs of each that are kept."""
    block, rows = None, []

    def kept() -> pa.RecordBatch:
        some = [rows[k] for k in rising([r["place"] for r in rows], [r["size"] for r in rows])]
        columns = [pa.array([r[c] for r in some], t) for c, t in (("file", pa.string()), ("g", pa.int64()), ("run", pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["file", "g", "run"])

    for batch in batches:
        for row in batch.to_pylist():
            here = (row["file"], row["g"], row["block"])
            if here != block:
                if rows:
                    yield kept()
                block, rows = here, []
            rows.append(row)
    if rows:
        yield kept()


def align_gap(left: list, right: list) -> Iterator[tuple[int, int]]:
    """The aligned places of two short lists, by the module's rules; in no order."""
    gaps = [(0, len(left), 0, len(right))]
    while gaps:
        lo, hi, low, high = gaps.pop()
        pairs = []
        while lo < hi and low < high and left[lo] == right[low]:
            pairs.append((lo, low))
            lo, low = lo + 1, low + 1
        tail = []
        while lo < hi and low < high and left[hi - 1] == right[high - 1]:
            hi, high = hi - 1, high - 1
            tail.append((hi, high))
        places: dict = {}
        for j in range(low, high):
            places.setdefault(right[j], []).append(j)
        ours: dict = {}
        for i in range(lo, hi):
            if left[i] in places:
                ours.setdefault(left[i], []).append(i)
        some = sorted((at[0], places[h][0]) for h, at in ours.items() if len(at) == 1 and len(places[h]) == 1)
        if not some and not pairs and not tail:
            some = sorted(p for h, at in ours.items() for p in zip(at, places[h], strict=False))
        kept = [some[k] for k in rising([j for _, j in some], [1] * len(some))]
        yield from pairs
        yield from tail
        yield from kept
        if kept:
            edge = [(lo - 1, low - 1), *kept, (hi, high)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edge, edge[1:], strict=False) if i + 1 < k and j + 1 < m]
        elif (pairs or tail) and ours:
            gaps.append((lo, hi, low, high))


def _align_gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (file, g, side, at, h) sorted by all but the last: aligned places of each small gap."""
    gap, sides = None, {0: ([], []), 1: ([], [])}

    def aligned() -> pa.RecordBatch:
        (i, left), (j, right) = sides[0], sides[1]
        found = list(align_gap(left, right))
        columns = [pa.array([gap[0]] * len(found), pa.string()), pa.array([gap[1]] * len(found), pa.int64())]
        columns += [pa.array([i[a] for a, _ in found], pa.int64()), pa.array([j[b] for _, b in found], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["file", "g", "i", "j"])

    for batch in batches:
        for row in batch.to_pylist():
            here = (row["file"], row["g"])
            if here != gap:
                if gap is not None:
                    yield aligned()
                gap, sides = here, {0: ([], []), 1: ([], [])}
            at, texts = sides[row["side"]]
            at.append(row["at"])
            texts.append(row["h"])
    if gap is not None:
        yield aligned()


def _longest_rising(pairs: DataFrame, chunk: int) -> DataFrame:
    """Of pairs ``(file, g, i, j)``, no two of one gap with an equal i or j, a longest set that rises in both."""
    ranked = Scan(Scan(pairs, order="i", by=tuple(GAP), chunk=chunk).number("a"), order="j", by=tuple(GAP), chunk=chunk).number("b")
    ranked = ranked.withColumn("_shift", F.col("b") - F.col("a"))
    beside = Scan(ranked, order="a", by=tuple(GAP), chunk=chunk).lag("_shift", "_before")
    fresh = (~F.col("_shift").eqNullSafe(F.col("_before"))).cast("long")
    marked = store(Scan(beside.withColumn("_new", fresh), order="a", by=tuple(GAP), chunk=chunk).running_sum("_new", "run"), "pairs")
    runs = marked.groupBy(*GAP, "run").agg(F.min("a").alias("first"), F.max("a").alias("last"), F.min("b").alias("place"), F.max("b").alias("top"), F.count(F.lit(1)).alias("size"))
    # a block ends where all places so far are taken: nothing behind it stands before it on the other side
    reach = Scan(runs, order="run", by=tuple(GAP), chunk=chunk).running_max("top", "_reach")
    ends = reach.withColumn("_ends", (F.col("_reach") == F.col("last")).cast("long"))
    blocks = Scan(ends, order="run", by=tuple(GAP), chunk=chunk).running_sum("_ends", "_upto").withColumn("block", F.col("_upto") - F.col("_ends"))
    blocks = blocks.select(*GAP, "block", "run", "place", "size")
    sorted_ = blocks.repartition(*GAP, "block").sortWithinPartitions(*GAP, "block", "run")
    keep = sorted_.mapInArrow(_rising_runs, "file string, g long, run long")
    return marked.join(keep, [*GAP, "run"]).select(*GAP, "i", "j")


def _edges(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal lines at the two edges of each gap as ``(file, g, i, j)``, and what each gap has left:
    its first and last line between them on either side."""
    size = lambda rows, at, s: rows.groupBy(*GAP).agg(F.min(at).alias(f"{s}0"), F.max(at).alias(f"{s}1"))
    gaps = size(left, "i", "l").join(size(right, "j", "r"), GAP)
    gaps = store(gaps.withColumn("least", F.least(F.col("l1") - F.col("l0"), F.col("r1") - F.col("r0")) + 1), "gaps")
    here = left.join(gaps, GAP).select(*GAP, "i", F.col("h").alias("hl"), (F.col("i") - F.col("l0")).alias("k"), (F.col("l1") - F.col("i")).alias("e"))
    there = right.join(gaps, GAP).select(*GAP, "j", F.col("h").alias("hr"), (F.col("j") - F.col("r0")).alias("k"), (F.col("r1") - F.col("j")).alias("e"))
    differs = F.col("hl") != F.col("hr")
    first = here.drop("e").join(there.drop("e"), [*GAP, "k"]).groupBy(*GAP).agg(F.min(F.when(differs, F.col("k"))).alias("head"))
    last = here.drop("k").join(there.drop("k"), [*GAP, "e"]).groupBy(*GAP).agg(F.min(F.when(differs, F.col("e"))).alias("tail"))
    known = gaps.join(first, GAP).join(last, GAP).withColumn("head", F.coalesce("head", "least"))
    known = store(known.withColumn("tail", F.least(F.coalesce("tail", "least"), F.col("least") - F.col("head"))), "edges")
    starts = known.select(*GAP, "l0", "r0", F.explode(F.expr("if(head > 0, sequence(0l, head - 1), array())")).alias("k"))
    ends = known.select(*GAP, "l1", "r1", F.explode(F.expr("if(tail > 0, sequence(0l, tail - 1), array())")).alias("k"))
    pairs = starts.select(*GAP, (F.col("l0") + F.col("k")).alias("i"), (F.col("r0") + F.col("k")).alias("j"))
    pairs = pairs.unionByName(ends.select(*GAP, (F.col("l1") - F.col("k")).alias("i"), (F.col("r1") - F.col("k")).alias("j")))
    left_over = known.select(*GAP, (F.col("l0") + F.col("head")).alias("l0"), (F.col("l1") - F.col("tail")).alias("l1"), (F.col("r0") + F.col("head")).alias("r0"), (F.col("r1") - F.col("tail")).alias("r1"))
    return pairs, left_over


def _candidates(left: DataFrame, right: DataFrame, repeated: bool, chunk: int) -> DataFrame:
    """Lines of each gap that stand once on either side, or of ``repeated`` texts the n-th occurrences, as ``(file, g, i, j)``."""
    key = [*GAP, "h"]
    if repeated:
        left, right = (Scan(rows, order=at, by=tuple(key), chunk=chunk).number("occ") for rows, at in ((left, "i"), (right, "j")))
        return left.join(right, [*key, "occ"]).select(*GAP, "i", "j")
    none = F.lit(None).cast("long")
    both = left.select(*key, "i", none.alias("j")).unionByName(right.select(*key, none.alias("i"), "j"))
    once = both.groupBy(*key).agg(F.count("i").alias("_l"), F.count("j").alias("_r"), F.max("i").alias("i"), F.max("j").alias("j"))
    return once.where("_l = 1 and _r = 1").select(*GAP, "i", "j")


def _next_gaps(rows: DataFrame, at: str, pairs: DataFrame, chunk: int) -> DataFrame:
    """Rows that are not aligned yet, in the gaps behind the lines that now are."""
    found = pairs.select(*GAP, at, F.col("i").alias("_anchor"))
    marked = rows.join(found, [*GAP, at], "left")
    behind = Scan(marked, order=at, by=tuple(GAP), chunk=chunk).last_known("_anchor", "_g")
    return behind.where("_anchor is null").select("file", F.coalesce("_g", "g").alias("g"), at, "h")


def placed(lines: DataFrame, at: str, chunk: int = CHUNK) -> DataFrame:
    """``(file, <at>, line_no, h)``: each line's 0-based place in its file and a hash of its text; a null text is empty."""
    rows = lines.select("file", "line_no", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("h"))
    return Scan(rows, chunk=chunk, tie=("h",)).number(at)


def align(left: DataFrame, right: DataFrame, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
    """``(file, i, j)``: the aligned lines of two logs by their places in files of the same name; i and j rise together.

    Texts are compared by 128 bits of hash.  Lines that moved are aligned at one of their places or not at all.
    """
    now = {}
    for name, rows, at in (("l", left, "i"), ("r", right, "j")):
        now[name] = store(placed(rows, at, chunk).select("file", F.lit(-1).cast("long").alias("g"), at, "h"), "lines")
    aligned, repeated = [], False
    while True:
        count = lambda rows, name: rows.groupBy(*GAP).agg(F.count(F.lit(1)).alias(name))
        sizes = store(count(now["l"], "n").join(count(now["r"], "m"), GAP).select(*GAP, (F.col("n") + F.col("m") <= small).alias("few")), "gaps")
        few, many = sizes.where("few").select(*GAP), sizes.where("not few").select(*GAP)
        if few.head(1):
            both = [now[s].join(few, GAP, "left_semi").select(*GAP, F.lit(k).alias("side"), F.col(at).alias("at"), "h") for k, (s, at) in enumerate((("l", "i"), ("r", "j")))]
            order = [*GAP, "side", "at"]
            dealt = both[0].unionByName(both[1]).repartition(*GAP).sortWithinPartitions(*order)
            aligned.append(store(dealt.mapInArrow(_align_gaps, "file string, g long, i long, j long"), "aligned"))
        if not many.head(1):
            break
        # gaps that hold a text of both sides
        now = {s: rows.join(many, GAP, "left_semi") for s, rows in now.items()}
        common = now["l"].select(*GAP, "h").distinct().join(now["r"].select(*GAP, "h").distinct(), [*GAP, "h"]).select(*GAP).distinct()
        common = store(common, "gaps")
        if not common.head(1):
            break
        l, r = (now[s].join(common, GAP, "left_semi") for s in "lr")
        edges, left_over = _edges(l, r)
        inner = lambda rows, at, s: rows.join(left_over, GAP).where(F.col(at).between(F.col(f"{s}0"), F.col(f"{s}1"))).select(*GAP, at, "h")  # noqa: E731,B023
        found = _longest_rising(_candidates(inner(l, "i", "l"), inner(r, "j", "r"), repeated, chunk), chunk)
        pairs = store(edges.unionByName(found), "aligned")
        repeated = not pairs.head(1)  # then every gap with a common text has one by occurrence
        if not repeated:
            aligned.append(pairs)
            now = {"l": store(_next_gaps(l, "i", pairs, chunk), "lines"), "r": store(_next_gaps(r, "j", pairs, chunk), "lines")}
        else:
            now = {"l": l, "r": r}
    if not aligned:
        return now["l"].select("file", "i", F.col("i").alias("j")).limit(0)
    out = aligned[0]
    for more in aligned[1:]:
        out = out.unionByName(more)
    return out.select("file", "i", "j")


def hunks(left: DataFrame, right: DataFrame, chunk: int = CHUNK, small: int = SMALL) -> DataFrame:
    """``(file, kind, left_start, left_lines, right_start, right_lines)``: two logs as runs in order, by places in files.

    ``kind`` is equal, removed (of the left log only), added (of the right one only), or modified, where
    both differ between the same equal lines.  A line that moved is removed at one place and added at
    the other.  Files are compared by name; one that only one log has is removed or added whole.
    """
    pairs = align(left, right, chunk, small)
    count = lambda rows, name: rows.groupBy("file").agg(F.count(F.lit(1)).alias(name))
    ends = count(left, "i").join(count(right, "j"), "file", "full").select("file", F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("j", F.lit(0)).alias("j"))
    rows = pairs.withColumn("end", F.lit(False)).unionByName(ends.withColumn("end", F.lit(True)))
    before = store(Scan(rows.withColumn("_at", F.struct("i", "j")), order="i", chunk=chunk, tie=("end",)).lag("_at", "_prev"), "aligned")
    i0, j0 = F.coalesce(F.col("_prev.i") + 1, F.lit(0)), F.coalesce(F.col("_prev.j") + 1, F.lit(0))
    gaps = before.select("file", i0.alias("left_start"), (F.col("i") - i0).alias("left_lines"), j0.alias("right_start"), (F.col("j") - j0).alias("right_lines"))
    gaps = gaps.where("left_lines > 0 or right_lines > 0")
    kind = F.when(F.col("right_lines") == 0, "removed").when(F.col("left_lines") == 0, "added").otherwise("modified")
    beside = (F.col("i") == F.col("_prev.i") + 1) & (F.col("j") == F.col("_prev.j") + 1)
    marked = before.where("not end").withColumn("_new", (~F.coalesce(beside, F.lit(False))).cast("long"))
    island = Scan(marked.drop("_at", "_prev"), order="i", chunk=chunk).running_sum("_new", "_island")
    equal = island.groupBy("file", "_island").agg(F.min("i").alias("left_start"), F.count(F.lit(1)).alias("left_lines"), F.min("j").alias("right_start"))
    out = ["file", "kind", "left_start", "left_lines", "right_start", "right_lines"]
    equal = equal.withColumn("kind", F.lit("equal")).withColumn("right_lines", F.col("left_lines"))
    return equal.select(*out).unionByName(gaps.withColumn("kind", kind).select(*out))
