"""Personal data and the terms that give it away: information-theoretic sanitisation.

Identifiers are found by their form.  A term that stands near one of them may reveal it
even when it is gone: by how much follows from how the two occur in the corpus.  With the
shares of documents that hold the identifier, the term, and both, the term tells
``log(p(both) / (p(identifier) p(term)))`` of the identifier's own information
``-log p(identifier)``.  Terms that tell more than a share of it are made general, terms that
tell almost all of it are removed.

Everything here is DataFrame operations: patterns run in the JVM, counts are grouped sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Identifiers in the order in which spans are listed; terms come last.
KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")

#: Fixed by the task; written so that no pattern goes over a text twice: a run is taken whole
#: (``++``), and where it fails it is not tried again from its middle (the look behind it).
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
ADDRESS = rf"^{PART}(?:\.{PART}){{3}}$"
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)


@dataclass(frozen=True)
class Params:
    """What counts as near, and what discloses."""

    #: Characters before and after an identifier that are its context.
    reach: int = 64
    #: Letters that a term has at least.
    letters: int = 4
    #: Different contexts of the identifier that hold the term; a copied context counts once.
    contexts: int = 2
    #: Shares of the identifier's information from which a term is made general, or removed.
    general: float = 0.5
    removed: float = 0.8


#: Shares are compared up to this, so that rounding decides nothing.
EPSILON = 1e-9


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits ends in its check digit: from the right every second digit counts twice."""

    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), value), F.lit(0), lambda a, v: a + v) % 10 == 0


def valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(ADDRESS)
    if kind == "card":
        return _once(digits_of(match), lambda d: F.length(d).between(*CARD_DIGITS) & F.when(F.length(d).between(*CARD_DIGITS), luhn(d)))
    if kind == "phone":
        return F.length(digits_of(match)).between(*PHONE_DIGITS)
    return F.lit(True)


def _hits(kind: str, text: Column, p: Params) -> Column:
    """Matches of one kind: place in order, length of what lies before, validity, value and context."""
    pattern = PATTERNS[kind]

    def of(x: Column) -> Column:
        def hit(match: Column, i: Column) -> Column:
            good = valid(kind, match)
            gap, rest = F.get(x["gaps"], i), F.get(x["gaps"], i + 1)
            return F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(gap).alias("gap"), F.length(match).alias("size"), good.alias("good"),
                F.when(good, F.lower(match) if kind in ("email", "ip") else digits_of(match)).alias("value"),
                F.when(good, F.substring(gap, -p.reach, p.reach)).alias("before"), F.when(good, F.substring(rest, 1, p.reach)).alias("after"),
                (F.length(rest) > p.reach).alias("more"),
            )

        return F.transform(x["matches"], hit)

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("gaps"))
    return _once(found, of)


def identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params(), row: Column | None = None) -> DataFrame:
    """``(row, id, kind, start, end, value, before, after, cut, more)``, stored: the identifiers of whole texts,
    leftmost and without overlap by kind, and for a document without any a row without a kind.

    Offsets are code points, the end excluded.  Matches that fail their check are dropped, and nothing
    is tried in their place.  ``row`` numbers the documents, so rows that repeat an id stay apart; a null
    text is empty.  A context reaches to the next match of its kind, if that is nearer than ``reach``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    number = F.monotonically_increasing_id() if row is None else row
    given = docs.select(number.alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    hits = F.concat(*[_hits(kind, F.col("text"), p) for kind in PATTERNS])
    found = given.select("row", "id", F.explode_outer(hits).alias("h")).select("row", "id", "h.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).withColumn("start", F.col("end") - F.col("size"))
    kept = found.select(
        "row", "id", F.when(F.col("good"), F.col("kind")).alias("kind"), "start", "end", "value", "before", "after", (F.col("gap") > p.reach).alias("cut"), "more"
    )
    return materialize(kept, "identifiers")


def _terms(context: Column, begins: Column, inner_start: Column, inner_end: Column, p: Params) -> Column:
    """Terms of a context with their offsets; a word that the context's edge cuts is none."""
    word = rf"\p{{L}}{{{p.letters},}}"

    def of(x: Column) -> Column:
        def term(match: Column, i: Column) -> Column:
            at = F.length(F.array_join(F.slice(x["gaps"], F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(x["words"], F.lit(1), i), ""))
            return F.struct(F.lower(match).alias("term"), (begins + at).alias("start"), (begins + at + F.length(match)).alias("end"))

        found = F.transform(x["words"], term)
        return F.filter(found, lambda t: ~(inner_start & (t["start"] == begins)) & ~(inner_end & (t["end"] == begins + F.length(context))))

    return _once(F.struct(F.regexp_extract_all(context, F.lit(word), F.lit(0)).alias("words"), F.split(context, word, -1).alias("gaps")), of)


def contexts(found: DataFrame, p: Params = Params()) -> DataFrame:
    """``(row, kind, value, context, term, start, end)``: the terms near each identifier."""
    near = F.concat(
        _terms(F.col("before"), F.col("start") - F.length("before"), F.col("cut"), F.lit(False), p),
        _terms(F.col("after"), F.col("end"), F.lit(False), F.col("more"), p),
    )
    rows = found.where("kind is not null").select(
        "row", "kind", "value", F.xxhash64("before", "after").alias("context"), F.explode(near).alias("t")
    )
    return rows.select("row", "kind", "value", "context", "t.*")


def document_counts(docs: DataFrame, text_col: str, p: Params = Params()) -> DataFrame:
    """``(term, n_term)``: in how many documents each term stands."""
    words = F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(rf"\p{{L}}{{{p.letters},}}"), F.lit(0))
    terms = F.array_distinct(F.transform(words, F.lower))
    return docs.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))


def disclosing(docs: DataFrame, found: DataFrame, near: DataFrame, text_col: str = "text", p: Params = Params()) -> DataFrame:
    """``(kind, value, term, share, removed)``: the terms that tell ``general`` or more of an identifier's information.

    All counts are of documents of the whole corpus.  An identifier that every document holds has no
    information to tell.
    """
    both = near.groupBy("kind", "value", "term").agg(F.count_distinct("row").alias("n_both"), F.count_distinct("context").alias("n_contexts"))
    both = materialize(both.where(F.col("n_contexts") >= p.contexts), "disclosing")
    held = found.where("kind is not null").groupBy("kind", "value").agg(F.count_distinct("row").alias("n_value"))
    wanted = both.select("term").distinct()
    counts = document_counts(docs, text_col, p).join(wanted, "term")
    total = found.agg(F.count_distinct("row").alias("n_docs"))
    joined = both.join(held, ["kind", "value"]).join(counts, "term").join(F.broadcast(total)).where("n_value < n_docs")  # one row
    number = lambda c: F.col(c).cast("double")
    share = F.ln(number("n_both") * number("n_docs") / (number("n_value") * number("n_term"))) / F.ln(number("n_docs") / number("n_value"))
    told = joined.select("kind", "value", "term", share.alias("share")).where(F.col("share") >= p.general - EPSILON)
    return told.withColumn("removed", F.col("share") >= p.removed - EPSILON)


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params(), row: Column | None = None) -> DataFrame:
    """``(row, id, kind, start, end, removed)``: identifiers (kinds 0 to 3) and the terms near them that
    disclose them (kind 4; ``removed`` or else made general), and a row without a kind for a document
    that has no identifier.

    A term is marked where it stands in the context of the identifier that it discloses, unless it
    overlaps an identifier.  Documents without identifiers have no terms.  No rows give no rows.
    """
    found = identifiers(docs, id_col, text_col, p, row)
    near = contexts(found, p)
    told = disclosing(docs, found, near, text_col, p)
    terms = near.join(told, ["kind", "value", "term"]).groupBy("row", "start", "end").agg(F.max("removed").alias("removed"))
    terms = materialize(terms, "terms")
    # The identifiers of those documents and the terms in one order: what reaches furthest before, and begins next.
    beside = found.where("kind is not null").join(terms.select("row").distinct(), "row", "left_semi")
    lined = beside.select("row", "start", "end", F.lit(None).cast("boolean").alias("removed"), F.lit(True).alias("fixed")).unionByName(terms.withColumn("fixed", F.lit(False)))
    order = Window.partitionBy("row").orderBy("start", "end", "fixed")
    before = F.max(F.when(F.col("fixed"), F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.min(F.when(F.col("fixed"), F.col("start"))).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    free = lined.withColumn("before", before).withColumn("behind", behind).where("not fixed")
    free = free.where((F.coalesce("before", F.lit(0).cast("long")) <= F.col("start")) & (F.col("behind").isNull() | (F.col("behind") >= F.col("end"))))
    marked = free.select("row", F.lit(None).alias("id"), F.lit(TERM).alias("kind"), "start", "end", "removed")
    return found.select("row", "id", "kind", "start", "end", F.lit(None).cast("boolean").alias("removed")).unionByName(marked)


def _listed(spans_of: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans_of), told), ",")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """``id_col`` and for each row of ``docs`` its counts of identifiers, ``base_sha256`` of their spans and all ``spans``,
    as ``kind:start:end``, by kind and start, comma-joined."""
    found = spans(docs, id_col, text_col, p)
    span = F.struct("kind", "start", "end")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{name}") for k, name in enumerate(KINDS) if k != TERM]
    by = found.groupBy("row").agg(F.max("id").alias(id_col), *counts, F.collect_list(F.when(F.col("kind").isNotNull(), span)).alias("all"))
    return by.select(
        id_col, *[f"n_{name}" for k, name in enumerate(KINDS) if k != TERM],
        F.sha2(_listed(F.filter("all", lambda s: s["kind"] != TERM)), 256).alias("base_sha256"), _listed(F.col("all")).alias("spans"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """``docs`` with ``sanitised``: the text with ``[kind]`` for each identifier, ``[term]`` for terms made general,
    and without the terms that are removed.  Of overlapping identifiers the first stands for what they
    share.  A null text stays null; a column ``sanitised`` is replaced.
    """
    held = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "documents")
    found = spans(held, id_col, text_col, p, F.col("_row")).where("kind is not null")
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    reached = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    cut = found.withColumn("reached", reached).where(F.col("end") > F.col("reached"))
    cut = cut.withColumn("new", F.when(F.col("removed"), "").otherwise(F.get(names, F.col("kind")))).withColumn("start", F.greatest("start", "reached"))
    by = cut.groupBy(F.col("row").alias("_row")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "new"))).alias("_cuts"))
    text, cuts = F.col(text_col), F.col("_cuts")
    until = lambda i: F.coalesce(F.get(cuts, i)["end"], F.lit(0).cast("long"))
    piece = lambda s, i: F.concat(F.substring(text, (until(i - 1) + 1).cast("int"), (s["start"] - until(i - 1)).cast("int")), s["new"])
    tail = F.substring(text, (until(F.size(cuts) - 1) + 1).cast("int"), F.length(text))
    new = F.when(cuts.isNull(), text).otherwise(F.concat(F.array_join(F.transform(cuts, piece), ""), tail))
    kept = [c for c in docs.columns if c != "sanitised"]
    return held.join(by, "_row", "left").select(*kept, new.alias("sanitised"))
