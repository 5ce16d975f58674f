"""Mixing of sources to target weights by iterative proportional fitting.

Documents fall into cells of source, language and topic.  Topics are learned from the
documents.  Stems (first letters of words) that stand in neither too many nor too few
documents are the vocabulary.  Frequent stems that meet each other little more often than chance
would have it are the topics' anchors.  In rounds as of k-means, each document goes to the topic
that most of its stems belong to, then each stem goes to the topic that uses it most for its
size; in the first round only the anchors belong to one.  Raking multiplies the cells' token weights until
their sums by source, by language and by topic meet the targets; the weights of a cell over
its tokens give the probability with which its documents stay.  Everything is a grouping or a
join over cells, in plain DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

UNKNOWN = "unknown"


@dataclass(frozen=True)
class Params:
    """Targets by dimension: a share for each named value, or a power of the observed token
    shares (1 keeps them, 0 makes them equal) for the values of a dimension without names."""

    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    powers: dict[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.7, "topic": 0.8})
    rate: float = 0.5
    sweeps: int = 10
    seed: int = 42
    #: Size of the topic model: topics, stems among which anchors are sought, stems, rounds.
    topics: int = 16
    seeds: int = 64
    terms: int = 2048
    rounds: int = 3
    #: How many times as often as by chance two anchors may stand in one document.
    lift: int = 3
    #: The most and least documents that a stem stands in, as one in so many.
    most_docs: int = 10
    least_docs: int = 1000


#: Letters of a stem; shorter words have none.
STEM = r"(\p{L}{4})\p{L}*"
OTHER = "other"


def tokens(text: str) -> Column:
    """Words by single spaces; a null or blank text has none."""
    c = F.col(text)
    words = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1
    return F.when(F.trim(c) != "", words).otherwise(0).cast("long")


def stems(text: str) -> str:
    """SQL of the different stems of a text, in lower case."""
    return f"array_distinct(regexp_extract_all(lower(coalesce(`{text}`, '')), r'{STEM}', 1))"


def among(found: str, of: list[str]) -> str:
    """SQL of the stems of ``found`` that are ``of`` these; SQL, as so many literals are slow to
    make one by one.  Stems are letters only."""
    return f"filter({found}, s -> s IN ({', '.join(map(repr, of))}))" if of else "cast(array() AS array<string>)"


#: Stems by the topic that they belong to; a topic's name is its anchor.
Topics = dict[str, list[str]]


def vocabulary(held: DataFrame, p: Params = Params()) -> tuple[int, dict[str, int]]:
    """The number of documents ``held`` (stems), and of those with each of the most frequent stems that
    stand in few enough documents, by falling frequency: at most ``p.terms`` reach the driver.
    Stems are short, so their sums are small partial aggregates, and counts cover all documents."""
    total = held.count()
    each = F.explode_outer("stems")  # a plain explode would read the stems twice, to filter by their number
    seen = held.select(each.alias("stem")).groupBy("stem").agg(F.count("stem").alias("n"))
    some = seen.where((F.col("n") > 0) & (F.col("n") * p.most_docs <= total) & (F.col("n") * p.least_docs >= total))
    return total, {r["stem"]: r["n"] for r in some.orderBy(F.desc("n"), "stem").limit(p.terms).collect()}


def anchors(found: DataFrame, total: int, known: dict[str, int], p: Params = Params()) -> list[str]:
    """Of the ``p.seeds`` most frequent stems, in that order, those that stand together with no
    anchor before them more than ``p.lift`` times as often as by chance; at most ``p.topics``.

    A document gives pairs of seeds only, so at most ``p.seeds``² of them, summed before they
    are shuffled.
    """
    seeds = list(known)[: p.seeds]
    if not seeds:
        return []
    pairs = F.transform(F.array(F.expr(among("found", seeds))), lambda some: F.flatten(F.transform(some, lambda a: F.transform(F.filter(some, lambda b: a < b), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    counts = found.select(F.explode(F.flatten(pairs)).alias("pair")).groupBy("pair.a", "pair.b").count()
    near = {frozenset((r["a"], r["b"])) for r in counts.collect() if r["count"] * total > p.lift * known[r["a"]] * known[r["b"]]}
    out: list[str] = []
    for stem in seeds:
        if len(out) < p.topics and not any(frozenset((stem, a)) in near for a in out):
            out.append(stem)
    return out


def topic(found: str, topics: Topics) -> Column:
    """The topic that most of the stems in SQL ``found`` belong to, the first by name of equals,
    ``other`` without any."""
    if not topics:
        return F.lit(OTHER)
    votes = ", ".join(f"struct(-size({among('some', own)}) AS n, '{name}' AS topic)" for name, own in topics.items())
    best = f"transform(array({found}), some -> array_min(array({votes})))[0]"  # stems are found once
    found_best = F.get(F.transform(F.array(F.expr(best)), lambda b: F.when(b["n"] < 0, b["topic"]).otherwise(OTHER)), F.lit(0))
    return F.coalesce(found_best, F.lit(OTHER))  # never null: a join on it needs no filter, which would find it again


def learn_topics(held: DataFrame, p: Params = Params()) -> tuple[Topics, DataFrame]:
    """Topics of documents ``held`` (stems, and what else is known of each), and these documents with
    the stems of the vocabulary instead (``found``), a table that the caller discards.

    A round is a pass over that table, which sums to at most ``p.topics`` × ``p.terms`` rows.  A
    stem goes to the topic in whose stems it has the largest share, the first by name of equals;
    one that stands in documents of no topic belongs to none.
    """
    total, known = vocabulary(held, p)
    rest = [c for c in held.columns if c != "stems"]
    found = materialize(held.select(*rest, F.expr(among("stems", list(known))).alias("found")), "found")
    topics: Topics = {a: [a] for a in anchors(found, total, known, p)}
    for _ in range(p.rounds if topics else 0):
        told = found.select(topic("found", topics).alias("topic"), "found")
        told = told.select("topic", F.explode_outer(F.when(F.col("topic") != OTHER, F.col("found"))).alias("stem"))  # an earlier filter would tell topics twice
        counts = told.where(F.col("stem").isNotNull()).groupBy("topic", "stem").agg(F.count(F.lit(1)).cast("double").alias("n"))
        sizes = counts.groupBy("topic").agg(F.sum("n").alias("size"))
        share = counts.join(sizes, "topic").select("stem", F.struct((-F.col("n") / F.col("size")).alias("less"), "topic").alias("use"))
        topics = {}
        for r in share.groupBy("stem").agg(F.min("use")["topic"].alias("topic")).orderBy("topic", "stem").collect():
            topics.setdefault(r["topic"], []).append(r["stem"])
    return topics, found


def draw(id_col: str, seed: int) -> Column:
    """A number in [0, 1) by the key alone, the same on every run and cluster."""
    text = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


def targets(cells: DataFrame, dim: str, p: Params) -> DataFrame:
    """``(dim, goal)``, shares that sum to 1 over the values present."""
    seen = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("_t"))
    named = p.shares.get(dim)
    if named:
        goal = F.coalesce(*[F.when(F.col(dim) == v, F.lit(float(s))) for v, s in named.items()], F.lit(0.0))
    else:
        goal = F.pow("_t", F.lit(p.powers.get(dim, 1.0)))
    seen = seen.select(dim, goal.alias("_g"))
    total = seen.agg(F.sum("_g").alias("_all"))
    return seen.join(F.broadcast(total)).select(dim, F.when(F.col("_all") > 0, F.col("_g") / F.col("_all")).otherwise(0.0).alias("goal"))


def rake(cells: DataFrame, p: Params = Params()) -> DataFrame:
    """``cells`` (source, lang, topic, tokens) with ``weight`` and ``probability``, and for each
    dimension the residual: by how much the weights of the cell's value miss its goal.

    A sweep scales the weights to each dimension's goals in turn, then holds a cell to what
    it has: no weight may ask for more tokens than there are at the sampling rate.  A cell
    without tokens gets weight and probability zero.  Sums by dimension are partial
    aggregates, so a source that holds most cells is no hot group.
    """
    dims = ["source", "lang", "topic"]
    cells = cells.where("tokens > 0")
    total = cells.agg(F.sum("tokens").cast("double").alias("_total"))
    now = cells.join(F.broadcast(total))
    now = now.select(*dims, "tokens", (F.col("tokens") / (F.lit(p.rate) * F.col("_total"))).alias("most"), (F.col("tokens") / F.col("_total")).alias("weight"))
    for d in dims:
        now = now.join(targets(cells, d, p).withColumnRenamed("goal", f"goal_{d}"), d)
    fixed = [*dims, "tokens", "most", *(f"goal_{d}" for d in dims)]
    now = materialize(now.select(*fixed, "weight"), "cells")
    for _ in range(p.sweeps):
        for d in dims:  # each step is a small table: plans that hold several double with each, and so does what the driver keeps of them
            sums = now.groupBy(d).agg(F.sum("weight").alias("_s"))
            scaled = F.when(F.col("_s") > 0, F.col("weight") * F.col(f"goal_{d}") / F.col("_s")).otherwise(0.0)
            held = F.least(scaled, F.col("most")) if d == dims[-1] else scaled
            after = materialize(now.join(sums, d).select(*fixed, held.alias("weight")), "cells")
            discard(now)
            now = after
    chance = F.least(F.lit(1.0), F.when(F.col("most") > 0, F.col("weight") / F.col("most")).otherwise(0.0))
    out = now
    for d in dims:
        out = out.join(now.groupBy(d).agg(F.sum("weight").alias(f"_{d}")), d)
    off = [(F.col(f"_{d}") - F.col(f"goal_{d}")).alias(f"{d}_residual") for d in dims]
    out = materialize(out.select(*dims, "tokens", "weight", chance.alias("probability"), *off), "raked")
    discard(now)
    return out


#: Columns that :func:`mix` adds.
ADDED = ("mix_topic", "mix_tokens", "mix_weight", "mix_probability", "mix_source_residual", "mix_lang_residual", "mix_topic_residual")


def _drawn(docs: DataFrame, id_col: str, text_col: str, p: Params, columns: list[str]) -> DataFrame:
    """The documents that stay, as a struct ``row`` of ``columns``, with the columns of ADDED.

    Stems are found in one pass over the texts and stored with what the result needs of each row."""
    kinds = dict(docs.dtypes)
    stored = [c for c in columns if kinds[c] != "void"]  # files hold no columns of that type
    held = materialize(docs.select(
        F.struct(*stored).alias("row") if stored else F.lit(True).alias("row"),
        F.coalesce(F.col("source").cast("string"), F.lit(UNKNOWN)).alias("source"),
        F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
        F.expr(stems(text_col)).alias("stems"),
        tokens(text_col).alias("mix_tokens"),
        draw(id_col, p.seed).alias("drawn"),
    ), "stems")
    dims = ["source", "lang", "topic"]
    topics, found = learn_topics(held.select("source", "lang", "mix_tokens", "stems"), p)
    told = found.select("source", "lang", topic("found", topics).alias("topic"), "mix_tokens")
    cells = materialize(told.groupBy(*dims).agg(F.sum("mix_tokens").alias("tokens")), "cells")
    discard(found)
    raked = rake(cells, p).select(
        *dims, F.col("weight").alias("mix_weight"), F.col("probability").alias("mix_probability"), *(F.col(f"{d}_residual").alias(f"mix_{d}_residual") for d in dims)
    )
    discard(cells)
    of = topic(among("stems", [s for own in topics.values() for s in own]), topics)
    seen = held.where("mix_tokens > 0").select("row", "source", "lang", of.alias("topic"), "mix_tokens", "drawn")
    kept = seen.join(raked, dims).where(F.col("drawn") < F.col("mix_probability")).withColumnRenamed("topic", "mix_topic")
    row = F.struct(*[F.col(f"row.`{c}`") if c in stored else F.lit(None).alias(c) for c in columns])
    return kept.withColumn("row", row) if columns else kept


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params(), columns: tuple[str, ...] | None = None) -> DataFrame:
    """The documents that stay, with their ``columns`` (by default all) and those of ADDED (which
    replace columns of the same names).

    A document stays if the number drawn by its id lies below its cell's probability, so rows
    that repeat an id stay or go together.  Null source or language counts as ``unknown``;
    a null or blank text has no tokens and goes, as does every text of a cell whose goal is
    zero.  Goals that the documents at hand cannot meet at the sampling rate are missed by the
    residuals.  No rows give no rows.
    """
    own = [c for c in columns or docs.columns if c not in ADDED]
    return _drawn(docs, id_col, text_col, p, own).select(*[F.col(f"row.`{c}`") for c in own], *ADDED)


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """The documents that stay, as they were."""
    return _drawn(docs, id_col, text_col, p, docs.columns).select("row.*")
