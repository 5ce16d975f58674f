"""One query per operator, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import dialogue, disclosure, embeddings, fingerprint, langid, mixing, oracles, packing, pages, quality, simhash, spelling, substrings, urlfilter
from .common import key_mod, read

QUALITY_CUT = 0.3

#: Bytes of a string that counts as a repeated passage: some forty words, fewer than a quoted
#: paragraph has, more than phrases share by chance.  The contract of op9 counts 400.
PASSAGE = 200


def vocabulary() -> tuple[str, str]:
    """The vocabulary's files: for the tokenizer, and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(read(spark, sf_dir, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = embeddings.near_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return near.withColumnRenamed("id", "vec_id")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", key_mod("doc_id", 4) == 2)
    model = langid.fit(docs.where("not held_out"), "text", "lang")
    return langid.identify(docs, model, also=("doc_id", "held_out"))


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(read(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), *vocabulary())


def dated_lists(captures: DataFrame) -> DataFrame:
    """Dated list entries over the hosts that the captures show; their days and the share of
    hosts follow from each host's first page and number of pages."""
    hosts = captures.select(urlfilter.host_of("url").alias("host"), "page_id").where("host <> ''")
    hosts = hosts.groupBy("host").agg(F.min("page_id").alias("lo"), F.count(F.lit(1)).alias("n"))
    site = r"regexp_replace(host, '^(www|m|blog)\\.', '')"
    rows = [
        ("spam", "host", "host", "add", "lo % 200", "lo % 3 = 0"),
        ("spam", "host", "host", "remove", "lo % 200 + 30 + n % 60", "lo % 3 = 0"),
        ("spam", "host", "host", "add", "lo % 200 + 120 + n % 60", "lo % 6 = 0"),
        ("adult", "domain", site, "add", "lo % 300", "lo % 5 = 1"),
        ("adult", "domain", site, "remove", "lo % 300 + 45", "lo % 10 = 1"),
        ("copyright", "prefix", "concat(host, '/en')", "add", "lo % 250", "lo % 7 = 2"),
    ]
    made = [
        f"if({when}, named_struct('list', '{name}', 'kind', '{kind}', 'value', {value}, 'action', '{action}', "
        f"'day', date_add(date'2024-01-01', cast({day} as int))), null)"
        for name, kind, value, action, day, when in rows
    ]
    entries = hosts.select(F.explode(F.expr(f"filter(array({', '.join(made)}), x -> x is not null)")).alias("e"))
    return entries.select("e.*")


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = read(spark, sf_dir, "pages").select(
        "page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id * 7919 % 366 as int))").alias("fetched_on")
    )
    return urlfilter.judge(captures, dated_lists(captures))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumns(
        {"source": F.coalesce("source", F.lit(mixing.UNKNOWN)), "lang": F.coalesce("lang", F.lit(mixing.UNKNOWN))}
    )
    return mixing.mix(docs, columns=("doc_id", "source", "lang")).select(
        "doc_id", "source", "lang", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"),
        F.round("mix_weight", 9).alias("cell_weight"), F.round("mix_probability", 9).alias("probability"),
        *((F.round(f"mix_{d}_residual", 9) + 0.0).alias(f"{d}_residual") for d in ("source", "lang", "topic")),
    )


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "pages")
    return pages.extract(table, pages.fit(table), also=("page_id", "url"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    labels = read(spark, sf_dir, "labels").select("doc_id", "quality").where(key_mod("doc_id", 5) != 0)
    labelled = docs.select("doc_id", "text").join(labels, "doc_id")
    return quality.fit(labelled, "doc_id", "text", "quality")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").withColumn("held_out", key_mod("doc_id", 5) == 0)
    model = quality_model(spark, docs, sf_dir)
    scored = quality.score(docs, model, also=("doc_id", "held_out"))
    return scored.withColumn("predicted", (F.col("score") >= QUALITY_CUT).cast("int"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digests(read(spark, sf_dir, "documents"), passage=PASSAGE)


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = read(spark, sf_dir, "conversations")
    return dialogue.audit_conversations(dialogue.damage(given), given)


#: One run of letters in so many loses a letter, which plants variants to find.
MISSPELT = 199


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(read(spark, sf_dir, "documents"), misspell=MISSPELT))


def op13_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.digests(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embeddings": op1_embeddings,
    "op2_langid": op2_langid,
    "op3_fingerprint": op3_fingerprint,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_urlfilter": op6_urlfilter,
    "op7_html": op7_html,
    "op8_quality": op8_quality,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_mixing": op10_mixing,
    "op11_conversations": op11_conversations,
    "op12_spelling": op12_spelling,
    "op13_personal": op13_personal,
}
ORACLES: dict[str, str] = {"op6_urlfilter": oracles.OP6, "op10_mixing": oracles.op10(), "op13_personal": oracles.op13()}
