"""Pattern libraries of any size: a text that a pattern needs decides which lines it is tried on.

Most patterns cannot match without some literal text.  Of that text a short piece, a gram, the
rarest by a sample of the lines, is looked up: lines are exploded into their grams and joined
with the grams of the patterns, and the pattern is tried only on the lines that it meets.
Patterns without such a text are tried on all lines, a block of them in each scan.  The
library stays a table; what the driver reads of it are those patterns, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import store
from .search import KEY, search_batch

#: Lengths of grams; a literal is looked up by the largest that it has.
GRAMS = (6, 3)
#: Of so many lines one is looked at to tell which grams are rare.  Changes no result.
SAMPLE = 64
#: Patterns without a literal that one scan tries.
BLOCK = 500
#: Texts into which alternatives are multiplied with what stands around them, at most; beyond it, the part with the longest
#: texts is looked up alone.  Changes no result.
SPREAD = 32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class _Unknown(Exception):
    """A construct from which nothing is concluded."""


class _Reader:
    """What a Java pattern needs: reads it once, and concludes only what holds in any match."""

    def __init__(self, pattern: str, spread: int = 1):
        self.p, self.at, self.spread = pattern, 0, spread

    def alternation(self) -> tuple[list[str] | None, list[str] | None]:
        """Literals of which any match holds one (None: unknown), and all its texts if it is nothing else."""
        branches = [self.branch()]
        while self.p[self.at : self.at + 1] == "|":
            self.at += 1
            branches.append(self.branch())
        if len(branches) == 1:
            return branches[0]
        texts = None
        if all(branch is not None for _, branch in branches):
            texts = list(dict.fromkeys(x for _, branch in branches for x in branch))
            texts = texts if len(texts) <= self.spread else None
        if any(needed is None for needed, _ in branches):
            return None, texts
        return [x for needed, _ in branches for x in needed], texts

    def branch(self) -> tuple[list[str] | None, list[str] | None]:
        run, found, pure = [""], [], True  # run: the texts that may stand here so far, one of them does
        while self.at < len(self.p) and self.p[self.at] not in "|)":
            texts, needed = self.item()
            least, plain = self.quantifier()
            joined = list(dict.fromkeys(a + b for a in run for b in texts)) if texts is not None else []
            fits = 0 < len(joined) <= self.spread
            if fits and plain:
                run = joined
                continue
            pure = False
            if fits and least:
                found.append(joined)
            elif needed and least:
                found.append(needed)
            found.append(run)
            run = texts if texts is not None and plain else [""]
        found.append(run)
        best = max((x for x in found if any(x)), key=lambda alternatives: min(map(len, alternatives)), default=None)
        return best, run if pure else None

    def item(self) -> tuple[list[str] | None, list[str] | None]:
        """The literal texts that may stand here (empty for what takes no place), and what a group needs."""
        c = self.p[self.at]
        self.at += 1
        if c == "\\":
            text = self.escape()
            return None if text is None else [text], None
        if c in "^$":
            return [""], None
        if c == ".":
            return None, None
        if c == "[":
            self.skip_class()
            return None, None
        if c == "(":
            return self.group()
        return [c], None

    def escape(self) -> str | None:
        c = self.p[self.at : self.at + 1]
        self.at += 1
        if not c:
            raise _Unknown
        if not c.isalnum():
            return c
        if c in "bBAZzG":
            return ""
        if c in "dDwWsShHvVRX" or c in "123456789":
            return None
        if c in "tnr":
            return {"t": "\t", "n": "\n", "r": "\r"}[c]
        raise _Unknown

    def skip_class(self) -> None:
        depth, first = 1, True
        while depth:
            c = self.p[self.at : self.at + 1]
            if not c:
                raise _Unknown
            self.at += 1
            if c == "\\":
                if self.p[self.at : self.at + 1] == "Q":
                    raise _Unknown
                self.at += 1
            elif c == "[":
                depth += 1
            elif c == "]" and not first:
                depth -= 1
            first = first and c == "^" or c == "["

    def group(self) -> tuple[list[str] | None, list[str] | None]:
        silent = False
        if self.p[self.at : self.at + 1] == "?":
            head = self.p[self.at + 1 : self.at + 3]
            if head[:1] in (":", ">"):
                self.at += 2
            elif head[:1] in ("=", "!"):
                self.at, silent = self.at + 2, True
            elif head in ("<=", "<!"):
                self.at, silent = self.at + 3, True
            elif head[:1] == "<":
                self.at = self.p.index(">", self.at) + 1
            elif self.p.startswith("?i)", self.at):  # grams fold case anyway
                self.at += 3
                return [""], None
            else:
                raise _Unknown
        needed, texts = self.alternation()
        if self.p[self.at : self.at + 1] != ")":
            raise _Unknown
        self.at += 1
        return (None, None) if silent else (texts, needed)

    def quantifier(self) -> tuple[bool, bool]:
        """Whether what stands before must be there, and whether it stands there just once."""
        c = self.p[self.at : self.at + 1]
        if not c or c not in "?*+{":
            return True, True
        self.at += 1
        least = c == "+"
        if c == "{":
            end = self.p.index("}", self.at)
            least = int(self.p[self.at : end].split(",")[0]) > 0
            self.at = end + 1
        if self.p[self.at : self.at + 1] in ("?", "+") and self.p[self.at : self.at + 1]:
            self.at += 1
        return least, False


def needed_literals(pattern: str, regex: bool = True, spread: int = 1) -> list[str] | None:
    """Texts, A-Z as a-z, of which every match of a Java pattern holds at least one; None if
    nothing is known, or one is shorter than a gram.  Alternatives are multiplied with the texts
    around them, ``id=(?:1|2)`` into ``id=1`` and ``id=2``, into so many texts at most."""
    try:
        found = _Reader(pattern, spread) if regex else None
        needed = found.alternation()[0] if found else [pattern]
        if found and found.at < len(pattern):
            return None
    except (_Unknown, ValueError, RecursionError):
        return None
    needed = [x.translate(str.maketrans(UPPER, LOWER)) for x in needed or ()]
    return sorted(set(needed)) if needed and min(map(len, needed)) >= GRAMS[-1] else None


def _literals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        needed = [needed_literals(p, spread=SPREAD) for p in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(needed, pa.list_(pa.string()))], ["pattern_id", "pattern", "needed"])


def folded(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def grams(text: Column, size: int) -> Column:
    """The different pieces of ``size`` characters."""
    pieces = lambda c: F.transform(F.sequence(F.lit(0), F.size(c) - size), lambda i: F.concat(*[F.get(c, i + k) for k in range(size)]))
    of = F.get(F.transform(F.array(F.split(text, "")), lambda c: F.when(F.size(c) >= size, pieces(c))), F.lit(0))
    return F.array_distinct(of)


def rules(patterns: DataFrame, case: bool = True) -> DataFrame:
    """``(pattern_id, pattern, needed)`` for the valid patterns of ``(pattern_id, pattern)``, as Java runs them."""
    made = F.when(F.col("pattern") != "", F.concat(F.lit("" if case else "(?i)"), "pattern"))
    given = patterns.select(F.col("pattern_id").cast("string").alias("pattern_id"), made.alias("pattern")).distinct()
    valid = F.expr("try_reflect('java.util.regex.Pattern', 'compile', pattern) is not null")
    return given.where("pattern is not null").where(valid).mapInArrow(_literals, "pattern_id string, pattern string, needed array<string>")


def search_library(lines: DataFrame, patterns: DataFrame, case: bool = True) -> DataFrame:
    """``(file, line_no, text, pattern_id)``: a row for each line and pattern of a table ``(pattern_id, pattern)``
    that matches it.  What is empty, null or no valid Java pattern matches nothing; a pattern_id that
    several patterns have counts once for a line.
    """
    known = store(rules(patterns, case), "rules")
    size = F.coalesce(*[F.when(F.length("literal") >= n, F.lit(n)) for n in GRAMS])
    literals = known.where("needed is not null").select("pattern_id", "pattern", F.explode("needed").alias("literal")).withColumn("size", size)
    literals = store(literals, "literals")
    found = None
    sizes = [r["size"] for r in literals.select("size").distinct().collect()]  # of GRAMS
    for n in sizes:
        wanted = literals.where(F.col("size") == n).withColumn("gram", F.explode(grams(F.col("literal"), n)))
        some = lines.where(F.pmod(F.xxhash64(*KEY), F.lit(SAMPLE)) == 0).select(F.explode(grams(folded("text"), n)).alias("gram"))
        seen = some.join(wanted.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("_n"))
        rare = F.min_by("gram", F.struct(F.coalesce("_n", F.lit(0)), "gram")).alias("gram")
        chosen = wanted.join(seen, "gram", "left").groupBy("pattern_id", "pattern", "literal").agg(rare)
        met = lines.select(*KEY, "text", F.explode(grams(folded("text"), n)).alias("gram")).join(store(chosen, "grams"), "gram")
        hits = met.where(F.contains(folded("text"), F.col("literal"))).where("text rlike pattern").select(*KEY, "text", "pattern_id")
        found = hits if found is None else found.unionByName(hits)
    if found is not None:
        found = found.dropDuplicates([*KEY, "pattern_id"])
    rest = known.where("needed is null")
    total = rest.count()
    if total:
        numbered = store(rest.select("pattern_id", "pattern").repartitionByRange("pattern_id", "pattern").sortWithinPartitions("pattern_id", "pattern"), "rest")
        part = None
        for k in range(-(-total // BLOCK)):
            block = numbered.where(F.pmod(F.xxhash64("pattern_id", "pattern"), F.lit(-(-total // BLOCK))) == k).collect()
            if block:
                hits = search_batch(lines, {f"{i}": r["pattern"] for i, r in enumerate(block)})
                names = F.array(*[F.lit(r["pattern_id"]) for r in block])
                hits = hits.select(*KEY, "text", F.get(names, F.col("pattern_id").cast("int")).alias("pattern_id"))
                part = hits if part is None else part.unionByName(hits)
        part = part.dropDuplicates([*KEY, "pattern_id"])
        found = part if found is None else found.unionByName(part).dropDuplicates([*KEY, "pattern_id"])
    if found is None:
        return lines.where(F.lit(False)).select(*KEY, "text", F.lit("").alias("pattern_id"))
    return found


def library_audit(lines: DataFrame, patterns: DataFrame, case: bool = True) -> DataFrame:
    """For each pattern_id of a table: whether one of its patterns is valid, matched lines, their share, first and last line."""
    ids = patterns.select(F.col("pattern_id").cast("string").alias("pattern_id")).distinct()
    good = rules(patterns, case).select("pattern_id").distinct().withColumn("valid", F.lit(True))
    hits = search_library(lines, patterns, case).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("matched"), F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    total = lines.agg(F.count(F.lit(1)).alias("scanned"))  # one row
    out = ids.join(good, "pattern_id", "left").join(hits, "pattern_id", "left").join(F.broadcast(total))
    matched = F.coalesce("matched", F.lit(0).cast("long"))
    share = F.round(F.when(F.col("scanned") > 0, matched / F.col("scanned")).otherwise(0.0), 6)
    return out.select("pattern_id", F.coalesce("valid", F.lit(False)).alias("valid"), matched.alias("matched"), share.alias("share"), "first_line", "last_line")
