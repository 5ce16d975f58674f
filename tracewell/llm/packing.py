"""Best-fit packing of tokenized documents into sequences of fixed length.

Only lengths matter to a packing, and there are at most ``size`` of them.  So Spark
counts pieces by length, a plan is made for these counts (a bounded table, whatever the
number of documents), and Spark deals the pieces out by the plan: each piece knows its
rank among the pieces of its length.  Texts and ids never leave the executors.

The plan holds bins by pattern, with how many bins share it.  Best fit in falling order
of length makes a first plan; a local search then exchanges one piece for one, two for
one, or moves one from the emptiest bins to fuller ones, always increasing the sum of
squared fills, until bins empty or nothing improves.
"""

from __future__ import annotations

import base64
import os
import re
import struct
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, raw_texts, small_batches

SIZE, END_ID = 1024, 2
MEMO_WORDS, MEMO_LENGTH = 200_000, 64
#: A space between two characters that are no white space always begins a token of the
#: vocabulary's splitting pattern, so texts may be cut before it.
CUT = re.compile(r"(?<=[^\s\x85\u180e\u200b\ufeff])(?= [^\s\x85\u180e\u200b\ufeff])")
#: Texts of which both forms of the vocabulary give the same ids: no special token (it has a "<")
#: and only characters whose class has never changed.
PLAIN = re.compile(r"[\n -;=-~\u00a1-\u024f]+")
ODD = re.compile(r"\s |[ ]\s|^ | $|[\x85\u180e\u200b\ufeff]")

Pattern = tuple[tuple[int, int], ...]


def encoder(path: str, ranks: str | None = None) -> Callable[[str], bytes]:
    """Ids of a text as little-endian unsigned 32-bit numbers, by the tokenizer file at ``path``.

    Texts are cut before single spaces, where a token always begins, and words (with their
    space) that come again are looked up.  ``ranks`` may name the same vocabulary as a file
    of ranks: new words of Latin letters are then merged by it, which gives the same ids in
    a fraction of the time; all others go to the tokenizer itself.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    young: dict[str, bytes] = {}
    old: dict[str, bytes] = {}
    loaded: list = []
    merge = _rank_encoder(ranks) if ranks else None

    def ids(text: str) -> list[int]:
        if merge is not None and PLAIN.fullmatch(text):
            return merge(text)
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(path))
        return loaded[0].encode(text, add_special_tokens=False).ids

    def learn(word: str) -> bytes:
        nonlocal young, old
        new = old.get(word)
        if new is None and word[-1:] in (".", ",") and word[-2:-1].isalpha():
            # after a letter the mark is a token, or begins one, of its own
            stem = word[:-1]
            new = (young.get(stem) or learn(stem)) + (young.get(word[-1]) or learn(word[-1]))
        if new is None:
            found = ids(word)
            new = pack_ids[len(found)](*found) if len(found) < 16 else np.array(found, "<u4").tobytes()
        if len(word) <= MEMO_LENGTH:
            if len(young) >= MEMO_WORDS:
                young, old = {}, young
            young[word] = new
        return new

    pack_ids = [struct.Struct(f"<{n}I").pack for n in range(16)]

    def encode(text: str) -> bytes:
        if ODD.search(text):
            words = CUT.split(text)
        else:
            words = text.replace(" ", "\0 ").split("\0") if "\0" not in text else CUT.split(text)
        get = young.get
        return b"".join([get(w) or learn(w) for w in words])

    return encode


def _rank_encoder(path: str) -> Callable[[str], list[int]]:
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, and ``task`` and
    ``nth`` (its number among the pieces of its length that the same task made).

    A document is its text's ids and one end id.  Only a longer one than ``size`` is cut,
    into pieces of ``size`` ids, but that the first takes what is left over.  A null text
    counts as empty: one piece of one id.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer, ranks), np.array([END_ID], "<u4").tobytes()
        task, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for k, raw in enumerate(raw_texts(batch.column(1))):
                ids = encode(raw.decode("utf-8", "replace")) + end
                total = len(ids) // 4
                cuts = [0, *range(total % size or size, total + 1, size)] if total > size else [0, total]
                for p, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    row.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[4 * a : 4 * b]))
                    nth.append(seen[b - a])
                    seen[b - a] += 1
            columns = [pa.array(x, pa.int64()) for x in (start, length, crc, nth)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *columns, pa.array([task] * len(row), pa.int32())],
                ["id", "piece", "start", "length", "ids_crc32", "nth", "task"],
            )

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, piece int, start long, length long, ids_crc32 long, nth long, task int"
    )


def _with(pattern: Pattern, take: Counter) -> Pattern:
    items = Counter(dict(pattern))
    items.update(take)
    return tuple(sorted((+items).items(), reverse=True))


def _fill(pattern: Pattern) -> int:
    return sum(s * n for s, n in pattern)


def best_fit(counts: dict[int, int], size: int = SIZE) -> Counter:
    """Bins by pattern, from best fit in falling order of length, for whole counts at once.

    Each piece goes to the fullest bin that still takes it.  As that bin stays the fullest
    one, it takes pieces of the same length as long as they fit.
    """
    room: list[Counter] = [Counter() for _ in range(size + 1)]
    for s in sorted(counts, reverse=True):
        left = counts[s]
        for r in range(s, size):
            each = r // s
            for pattern, n in list(room[r].items()):
                if not left:
                    break
                full = min(n, left // each)
                parts = [(full, each)] + ([(1, left - full * each)] if full < n and left - full * each else [])
                for bins, k in parts:
                    if bins:
                        room[r][pattern] -= bins
                        room[r - k * s][_with(pattern, Counter({s: k}))] += bins
                        left -= bins * k
            room[r] = +room[r]
        each = size // s
        for bins, k in ((left // each, each), (1, left % each)):
            if bins and k:
                room[size - k * s][((s, k),)] += bins
    return sum(room, Counter())


def _takes(pattern: Pattern) -> dict[tuple[int, int], tuple[int, ...]]:
    """What an exchange may take from a bin, one or two pieces, by their number and their
    length together."""
    some = [(s,) for s, _ in pattern]
    some += combinations([s for s, n in pattern for _ in range(min(n, 2))], 2)
    found: dict[tuple[int, int], tuple[int, ...]] = {}
    for x in some:
        found.setdefault((len(x), sum(x)), x)
    return found


class Partners:
    """Open patterns by what they can give back and by their room.

    ``next[c, k, r]`` is the least room from r on of a pattern that can give back c pieces of
    length k together (``size + 1`` if there is none), so that a look at it is a look at all
    patterns.
    """

    def __init__(self, size: int):
        self.size = size
        self.next = np.full((3, size + 1, size + 2), size + 1, np.int32)
        self.cells: dict[tuple[int, int, int], dict[Pattern, None]] = {}

    def add(self, pattern: Pattern) -> None:
        room = self.size - _fill(pattern)
        for c, k in [(0, 0), *_takes(pattern)]:
            cell = self.cells.setdefault((c, k, room), {})
            if not cell:
                upto = self.next[c, k, : room + 1]
                np.minimum(upto, room, out=upto)
            cell[pattern] = None

    def remove(self, pattern: Pattern) -> None:
        room = self.size - _fill(pattern)
        for c, k in [(0, 0), *_takes(pattern)]:
            cell = self.cells[c, k, room]
            del cell[pattern]
            if not cell:
                upto = self.next[c, k, : room + 1]
                upto[upto == room] = self.next[c, k, room + 1]
                del self.cells[c, k, room]

    def best(self, a: Pattern) -> tuple[Pattern, tuple[int, ...], tuple[int, ...]] | None:
        """The exchange that fills a partner no emptier than ``a`` most: (the fullest such
        partner, what ``a`` gives, what it gives back)."""
        most, found = 0, None
        limit = self.size - _fill(a)
        for (n, g), give in _takes(a).items():
            low = max(0, g - limit)
            for c in range(4 - n):
                back = np.arange(low, min(g - most, 1) if c == 0 else g - most)
                rooms = self.next[c, back, g - back]
                at = int(np.argmax(rooms <= limit)) if len(back) else 0
                if len(back) and rooms[at] <= limit:
                    most = g - int(back[at])
                    found = (c, int(back[at]), int(rooms[at])), give
        if found is None:
            return None
        cell, give = found
        b = next(iter(self.cells[cell]))
        return b, give, _takes(b)[cell[:2]] if cell[0] else ()


def local_search(bins: Counter, size: int = SIZE) -> Counter:
    """Exchange pieces between underfull bins while the sum of squared fills grows.

    Each step takes the emptiest bins and, of all open ones, the partner that they can fill
    most: a move (one or two for none), a swap (one for one), two for one or one for two,
    done for all bins of both patterns at once.  What a partner gains makes it the fuller,
    so the sum of squares grows with every step.  Patterns without a partner are set aside
    until all others have been looked at, and looked at again if any pattern has changed
    since.  Ends when the number of bins meets the bound of total length over ``size``, or
    when no exchange improves.
    """
    bins = Counter(bins)
    total = bins.total()
    least = -(-sum(_fill(p) * n for p, n in bins.items()) // size)
    if total <= least:
        return bins
    partners = Partners(size)
    todo = sorted((_fill(p), p) for p in bins if _fill(p) < size)
    for _, p in todo:
        partners.add(p)
    stuck: list[Pattern] = []
    changed = False

    def change(pattern: Pattern, n: int) -> None:
        had = bins[pattern]
        bins[pattern] = had + n
        if not bins[pattern]:
            del bins[pattern]
        if _fill(pattern) < size:
            if not had:
                partners.add(pattern)
            elif had + n == 0:
                partners.remove(pattern)
            if n > 0:
                heappush(todo, (_fill(pattern), pattern))

    while total > least:
        if not todo:
            if not changed:
                break
            todo = sorted((_fill(p), p) for p in set(stuck) if p in bins)
            stuck, changed = [], False
            continue
        _, a = heappop(todo)
        if a not in bins:
            continue
        alone = bins[a] == 1
        if alone:
            partners.remove(a)
        best = partners.best(a)
        if alone:
            partners.add(a)
        if best is None:
            stuck.append(a)
            continue
        b, give, back = best
        n = bins[a] // 2 if a == b else min(bins[a], bins[b])
        less, more = Counter(dict(a)), Counter(dict(b))
        less.subtract(give)
        less.update(back)
        more.subtract(back)
        more.update(give)
        change(a, -n)
        change(b, -n)
        for gets in (less, more):
            pattern = _with((), gets)
            if pattern:
                change(pattern, n)
            else:
                total -= n
        if a in bins:
            heappush(todo, (_fill(a), a))
        changed = True
    return bins


def plan(counts: dict[int, int], size: int = SIZE) -> dict[str, np.ndarray]:
    """Where the pieces of each length go: rows by (length, first rank), each for the ranks
    up to the next row's, ``each`` of them to a bin from ``bin`` on, at ``offset`` and then
    every ``length`` ids."""
    rows, used, at = [], Counter(), 0
    for pattern, n in sorted(local_search(best_fit(counts, size), size).items(), reverse=True):
        offset = 0
        for s, each in pattern:
            rows.append((s, used[s], at, each, offset))
            used[s] += each * n
            offset += s * each
        at += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "each", "offset"), table.T, strict=True))


def pack(docs: DataFrame, tokenizer: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``.

    Columns: the id, piece, start, length, ids_crc32, sequence_id, offset.  Repeated rows
    and null ids are packed like any other.  No rows give no rows.
    """
    spark = docs.sparkSession
    cut = materialize(pieces(docs, tokenizer, ranks, id_col, text_col, size), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = materialize(by_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))), "piece-counts")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(plan(counts, size))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = sent.value
        keys = (p["length"] << 48) + p["rank"]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = np.searchsorted(keys, (length << 48) + rank, side="right") - 1
            nth = rank - p["rank"][row]
            each = p["each"][row]
            out = [batch.column(k) for k in range(5)]
            out += [pa.array(p["bin"][row] + nth // each), pa.array(p["offset"][row] + nth % each * length)]
            yield pa.RecordBatch.from_arrays(out, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # Small as it is written, the table of bases has a row for each length of each task: too many to broadcast
    ranked = cut.join(by_task.select("task", "length", "base").hint("merge"), ["task", "length"]).select(
        "id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank")
    )
    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.mapInArrow(
        place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
    return placed.withColumnRenamed("id", id_col)
