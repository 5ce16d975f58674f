"""Repair of damaged conversations by the cheapest edits, found with the auction algorithm.

A conversation should read as an optional system turn and then pairs of user and assistant
turns.  Its rows in order span a lattice: a node is (rows used up, what the kept turns end
with), an arc is an edit with an integer cost.  The auction algorithm for shortest paths
extends a path from the start while the price of its last node equals the cheapest arc
plus the price behind it, and otherwise raises that price and contracts the path by one
node.  When the path reaches the end, prices are duals: every arc of every cheapest path is
tight, so the edits of least letters among the cheapest are traced along tight arcs.

A conversation of more rows than CHUNK is cut into fragments, which tasks solve beside each
other: the costs between the states at a fragment's two ends first, then, with the prices
at its far end known, its edits.  Only what stands at the ends of fragments is passed on
in order, by a stream over a conversation's fragments that holds one of them at a time.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_cache, materialize, small_batches

#: Rows of a conversation that are solved in one go.
CHUNK = 64
#: Solved fragments that a task remembers.
REMEMBERED = 1 << 14

#: What a row may cost: edits, and a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: The turn that may follow each state, and the state it leads to.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Prices behind the last row: only nothing at all, or a finished pair, may end a conversation.
END = (0, math.inf, math.inf, 0)

SPACE = " \t\n\u000b\f\r"


# --- the lattice of one fragment -------------------------------------------------------------


class Lattice:
    """Nodes (row k, state q) as 4 k + q, and the end; arcs as (label, cost, node).

    ``codes`` has two letters for each row: its role's initial (``s``, ``u``, ``a``, else ``x``) and
    its fault (``b`` blank, ``d`` duplicate, ``t`` truncated, ``-`` none).  ``ends`` are the prices
    behind each state.  Turns inserted between two fragments belong to the later one, so only
    the ``last`` fragment inserts behind its rows.
    """

    def __init__(self, codes: str, ends: tuple[float, ...], last: bool):
        self.n, self.end = len(codes) // 2, 4 * (len(codes) // 2) + 4
        self.arcs: list[list[tuple[str, int, int]]] = []
        least = min(ends)
        floor = [least]
        for k in range(self.n - 1, -1, -1):
            floor.append(floor[-1] + _forced(codes[2 * k + 1]))
        floor.reverse()
        #: Lower bounds of what is left to pay; prices may start from any such bounds.
        self.price: list[float] = []
        for k in range(self.n + 1):
            initial, fault = codes[2 * k : 2 * k + 2] if k < self.n else ("", "")
            for q in range(STATES):
                self.arcs.append(self._from(k, q, initial, fault, ends, last))
                self.price.append(floor[k])
        self.price.append(0)
        finite = [e for e in ends if e < math.inf]
        #: No way to the end costs more than deleting all rows and completing a pair.
        self.most = DELETE * self.n + 3 * INSERT + max(finite, default=0)

    def _from(self, k: int, q: int, initial: str, fault: str, ends: tuple[float, ...], last: bool) -> list[tuple[str, int, int]]:
        role, after = NEXT[q]
        out: list[tuple[str, int, int]] = []
        if k == self.n:
            if ends[q] < math.inf:
                out.append(("", ends[q], self.end))
            return [*out, ("I", INSERT, 4 * k + after)] if last else out
        below = 4 * (k + 1)
        out += [("D", DELETE, below + q), ("I", INSERT, 4 * k + after)]
        if fault not in "bd":
            more = TRUNCATED if fault == "t" else 0
            if initial == role:
                return [*out, ("K", KEEP + more, below + after)]
            if initial == "s" and q == START:
                out.append(("K", KEEP + more, below + SYSTEM))
            out.append(("R", REROLE + more, below + after))
        return out

    def auction(self, q: int) -> float:
        """The least cost from state ``q`` before the first row to the end; leaves the duals in
        ``price``, which stay bounds for the next start."""
        price, arcs, path = self.price, self.arcs, [q]
        while path[-1] != self.end:
            i = path[-1]
            best, to = math.inf, -1
            for _, cost, j in arcs[i]:
                if cost + price[j] < best:
                    best, to = cost + price[j], j
            if best > self.most:
                best = math.inf
            if price[i] < best:  # contraction
                price[i] = best
                if len(path) > 1:
                    path.pop()
            elif best == math.inf:
                if len(path) == 1:
                    return math.inf
                path.pop()
            else:
                path.append(to)  # extension
        return price[q]

    def trace(self, q: int) -> tuple[str, int]:
        """The edits of least letters over tight arcs from state ``q``, and the state they end in."""
        price, arcs = self.price, self.arcs
        tight = [[(a, j) for a, cost, j in arcs[i] if price[i] == cost + price[j] < math.inf] for i in range(self.end)]
        leads = [False] * self.end + [True]
        for k in range(self.n, -1, -1):
            for _ in range(STATES):  # inserted turns lead from state to state of the same row
                for i in range(4 * k, 4 * k + STATES):
                    leads[i] = leads[i] or any(leads[j] for _, j in tight[i])
        out, i = [], q
        while True:
            label, j = min((a, j) for a, j in tight[i] if leads[j])
            if j == self.end:
                return "".join(out), i % STATES
            out.append(label)
            i = j


def _forced(fault: str) -> int:
    return DELETE if fault in "bd" else TRUNCATED if fault == "t" else 0


def crossing(codes: str) -> list[float]:
    """Least costs from each state before a fragment (not the last) to each state behind it, row by row."""
    columns = []
    for e in range(STATES):
        lattice = Lattice(codes, tuple(0 if k == e else math.inf for k in range(STATES)), False)
        columns.append([lattice.auction(q) for q in range(STATES)])
    return [columns[e][q] for q in range(STATES) for e in range(STATES)]


def edits(codes: str, ends: tuple[float, ...], last: bool, states: tuple[int, ...]) -> list[tuple[str, int]]:
    """Of each given state before a fragment its edits and the state behind it; ("", -1) without a way."""
    lattice, out = Lattice(codes, ends, last), []
    for q in states:
        out.append(lattice.trace(q) if lattice.auction(q) < math.inf else ("", -1))
    return out


# --- rows, faults and fragments --------------------------------------------------------------


def conversation_key(column: str = "conv_id") -> F.Column:
    """A conversation's id as text; a null id is a conversation of its own."""
    text = F.col(column).cast("string")
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit("="), text))


def damage(rows: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)`` with one row of five damaged, by the crc32 of ``conv_id:turn``
    modulo 20: 0 drops it, 1 empties its text, 2 removes ``.!?``, 3 repeats it, 4 makes it a user's.
    A null counts as one space, in the key too; a null turn stays null."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    out = rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """``(key, pos, chunk, turn, role, text, code)``: rows in order, stored.

    Rows stand by turn, nulls first, rows of equal turn by role and then by a hash of the text, in
    ranges of conversation and turn, so a conversation of very many rows lies in many tasks.
    A row is blank without a character that is no white space, else a duplicate if its role and text
    stood before in its conversation, else truncated unless it ends in ``.!?``.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    order = ["key", "turn", "role", "mark", "given"]
    found = rows.select(conversation_key().alias("key"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    found = found.withColumn("mark", mark).withColumn("given", F.monotonically_increasing_id())
    found = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()).drop("given")
    found = materialize(found, "turns")

    repeated = found.groupBy("key", "mark").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    many = found.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CHUNK)
    last = F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)
    fault = F.when(last == "", "b").when(F.col("pos") > F.col("first"), "d").when(~last.isin(".", "!", "?"), "t").otherwise("-")
    initial = F.substring("role", 1, 1)
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault)
    chunk = F.when(F.col("rows").isNotNull(), F.shiftright("pos", 6)).otherwise(F.lit(-1).cast("long"))
    return found.join(repeated, ["key", "mark"], "left").join(many, "key", "left").select("key", "pos", chunk.alias("chunk"), "turn", "role", "text", code.alias("code"))


def _codes(rows: DataFrame) -> DataFrame:
    """``(key, chunk, codes)``: each fragment's rows as one short text."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "code")))
    return rows.groupBy("key", "chunk").agg(F.array_join(F.transform(listed, lambda r: r["code"]), "").alias("codes"))


def _cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solved = bounded_cache(REMEMBERED, crossing)
    for batch in batches:
        cost = pa.array([solved(c) for c in batch.column(2).to_pylist()], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, cost], ["key", "chunk", "codes", "cost"])


def _prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments from the last of each conversation to the first: the prices behind each."""
    key, ends = None, END
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            last = row["key"] != key
            if last:
                key, ends = row["key"], END
            out.append((row["key"], row["chunk"], row["codes"], list(ends), last))
            if last:  # behind the last rows turns may be inserted, which costs do not hold yet
                lattice = Lattice(row["codes"], END, True)
                ends = tuple(lattice.auction(q) for q in range(STATES))
            else:
                cost = row["cost"]
                ends = tuple(min(cost[STATES * q + e] + ends[e] for e in range(STATES)) for q in range(STATES))
        kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.float64()), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 5, kinds, strict=True)], ["key", "chunk", "codes", "ends", "last"])


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits and end states of each fragment, for each state it may begin with."""
    for batch in batches:
        found = [edits(r["codes"], tuple(r["ends"]), r["last"], tuple(range(STATES))) for r in batch.to_pylist()]
        audits = pa.array([[a for a, _ in f] for f in found], pa.list_(pa.string()))
        exits = pa.array([[e for _, e in f] for f in found], pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], audits, exits], ["key", "chunk", "codes", "audits", "exits"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments from the first of each conversation to the last: the edits of the state that each begins with."""
    key, state = None, START
    for batch in batches:
        begins, audits = [], []
        for row in batch.to_pylist():
            if row["key"] != key:
                key, state = row["key"], START
            begins.append(state)
            audits.append(row["audits"][state])
            state = row["exits"][state]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(begins, pa.int32()), pa.array(audits, pa.string())], ["key", "chunk", "codes", "begins", "audit"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    solved = bounded_cache(REMEMBERED, lambda c: edits(c, END, True, (START,))[0][0])
    for batch in batches:
        audit = pa.array([solved(c) for c in batch.column(2).to_pylist()], pa.string())
        begins = pa.array([START] * batch.num_rows, pa.int32())
        yield pa.RecordBatch.from_arrays([*batch.columns, begins, audit], ["key", "chunk", "codes", "begins", "audit"])


def audited(rows: DataFrame) -> DataFrame:
    """``(key, chunk, codes, begins, audit)`` for each fragment of :func:`ordered` rows."""
    frame, found = "key string, chunk long, codes string", materialize(_codes(rows), "fragments")
    out = found.where("chunk < 0").mapInArrow(_whole, f"{frame}, begins int, audit string")
    cut = found.where("chunk >= 0")
    if cut.head(1):
        cost = cut.repartition("key", "chunk").mapInArrow(_cross, f"{frame}, cost array<double>")
        behind = cost.repartition("key").sortWithinPartitions("key", F.desc("chunk")).mapInArrow(_prices, f"{frame}, ends array<double>, last boolean")
        traced = behind.repartition("key", "chunk").mapInArrow(_trace, f"{frame}, audits array<string>, exits array<int>")
        chosen = traced.repartition("key").sortWithinPartitions("key", "chunk").mapInArrow(_choose, f"{frame}, begins int, audit string")
        out = out.unionByName(chosen)
    return materialize(out, "audits")


class Repair:
    """Applies a fragment's edits to its rows as they come: gives the repaired turns in order."""

    def __init__(self) -> None:
        self.begin("", "", START)

    def begin(self, codes: str, audit: str, state: int) -> None:
        self.codes, self.audit, self.state, self.row, self.at = codes, audit, state, 0, 0

    def _turn(self) -> str:
        role, self.state = NEXT[self.state]
        return ROLES[role]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._turn(), ""

    def feed(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """``(edit, role, text)`` of the turns that a row leaves, the ones inserted before it first."""
        yield from self.inserted()
        edit, code = self.audit[self.at], self.codes[2 * self.row]
        self.at += 1
        self.row += 1
        if edit == "R":
            yield edit, self._turn(), text
        elif edit == "K":
            if code == "s":
                self.state = SYSTEM
            else:
                self._turn()
            yield edit, role, text
        if 2 * self.row == len(self.codes):
            yield from self.inserted()


def _with_audits(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """Fragments and their rows in one table: ``kind`` 0 and 1."""
    heads = audits.select("key", "chunk", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "codes", "begins", "audit")
    body = rows.select("key", "chunk", F.lit(1).alias("kind"), "pos", "turn", "role", "text", F.lit("").alias("codes"), F.lit(0).alias("begins"), F.lit("").alias("audit"))
    return heads.unionByName(body)


def repaired(rows: DataFrame) -> DataFrame:
    """The repaired turns of ``rows(conv_id, turn, role, text)``: ``(conv_id, at, turn, role, text, edit)``,
    a conversation's turns in the order of ``at``; an inserted turn has a null ``turn`` and an empty text.

    Nulls count as one space in role and text; a null conv_id is a conversation of its own; a null
    turn stands first.  A conversation whose cheapest repair deletes all its rows has none left.
    Fragments are repaired apart, so no conversation is gathered in one task.
    """
    ids = rows.groupBy(conversation_key().alias("key")).agg(F.first("conv_id").alias("conv_id"))
    turns = ordered(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair, at = Repair(), 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    repair.begin(r["codes"], r["audit"], r["begins"])
                    continue
                left = list(repair.feed(r["role"], r["text"]))
                for n, (edit, role, text) in enumerate(left):
                    out.append((r["key"], r["pos"], n, None if edit == "I" else r["turn"], role, text, edit))
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string()]
            names = ["key", "pos", "n", "turn", "role", "text", "edit"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, kinds, strict=True)], names)

    small_batches(rows.sparkSession)
    both = _with_audits(turns, audited(turns)).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "kind", "pos")
    made = both.mapInArrow(run, "key string, pos long, n int, turn long, role string, text string, edit string")
    return made.join(ids, "key").select("conv_id", F.struct("pos", "n").alias("at"), "turn", "role", "text", "edit")


class Summary:
    """What is told of one conversation, in one pass over its rows in order."""

    FIELDS = ("key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")

    def __init__(self, key: str):
        self.key, self.faults, self.illegal, self.cost, self.audit = key, {"b": 0, "d": 0, "t": 0, "-": 0}, 0, 0, []
        self.before, self.digest, self.lines = "", hashlib.sha256(), 0
        self.first = self.latest = None
        self.turns, self.repair, self.at = 0, Repair(), 0

    def fragment(self, codes: str, audit: str, state: int) -> None:
        self.repair.begin(codes, audit, state)
        self.audit.append(audit)
        row = 0
        for edit in audit:
            self.cost += {"K": KEEP, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
            if edit != "I":
                self.cost += TRUNCATED * (edit != "D" and codes[2 * row + 1] == "t")
                row += 1
        for k in range(0, len(codes), 2):
            self.faults[codes[k + 1]] += 1
            if self.before:
                self.illegal += self.before + codes[k] not in LEGAL
            self.before = codes[k]

    def row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.latest:
            self.first = turn if self.first is None else self.first
            self.latest, self.turns = turn, self.turns + 1
        for _, said_by, said in self.repair.feed(role, text):
            self.digest.update(("\n" * (self.lines > 0) + f"{said_by}:{said}").encode())
            self.lines += 1

    def result(self) -> tuple:
        gaps = 0 if self.first is None else self.latest - self.first + 1 - self.turns
        return (self.key, gaps, self.faults["b"], self.faults["d"], self.faults["t"], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


def summaries(rows: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`ordered` rows: ``key``, ``gaps`` (turn numbers missing
    between the first and the last), counts of ``blank``, ``duplicate`` and ``truncated`` rows and of ``illegal``
    neighbours, ``cost`` and ``audit`` of the repair, and ``repaired_sha256`` of its lines ``role:text``.

    A digest is made of a conversation's lines one after the other, so this streams each
    conversation through one task, a line at a time; what it holds is the audit.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Summary | None = None
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string()]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now is None or now.key != r["key"]:
                    if now:
                        out.append(now.result())
                    now = Summary(r["key"])
                if r["kind"] == 0:
                    now.fragment(r["codes"], r["audit"], r["begins"])
                else:
                    now.row(r["turn"], r["role"], r["text"])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 9, kinds, strict=True)], list(Summary.FIELDS))
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(now.result(), kinds, strict=True)], list(Summary.FIELDS))

    small_batches(rows.sparkSession)
    both = _with_audits(rows, audited(rows)).repartition("key").sortWithinPartitions("key", "chunk", "kind", "pos")
    counts = ", ".join(f"{c} long" for c in Summary.FIELDS[1:7])
    return both.mapInArrow(run, f"key string, {counts}, audit string, repaired_sha256 string")


def audit_conversations(rows: DataFrame, originals: DataFrame | None = None) -> DataFrame:
    """``conv_id`` and the columns of :func:`summaries` for each conversation of ``originals`` (``rows`` itself
    where none are given).  A conversation without rows has zeros, an empty audit and the hash of nothing.

    Nulls are as in :func:`repaired`; rows that repeat are duplicates; other columns are not read.
    No rows give no rows.
    """
    given = rows if originals is None else originals
    ids = given.groupBy(conversation_key().alias("key")).agg(F.first("conv_id").alias("conv_id"))
    told = ids.join(summaries(ordered(rows)), "key", "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in Summary.FIELDS[1:7]}
    nothing = hashlib.sha256().hexdigest()
    told = told.withColumns({**zeros, "audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.lit(nothing))})
    return told.select("conv_id", *Summary.FIELDS[1:])
