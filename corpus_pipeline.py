"""A training-data pipeline of five stages, each one of the operators of ``tracewell.llm``.

``run(spark, sf_dir)`` applies the stages to ``documents`` in order; each stage's result is
written as Parquet and read again as the next one's documents, so that no stage repeats
another's work and a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import mixing, packing, quality, simhash, substrings
from tracewell.llm.common import discard, keep_table, materialize, read, temporary_tables
from tracewell.llm.queries import PASSAGE, QUALITY_CUT, quality_model, vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, by the query's own cut."""
    model = quality_model(spark, docs, sf_dir)
    rows = docs.select("text", F.struct(*docs.columns).alias("row"))
    scored = quality.score(rows, model, also=("row",))
    return scored.where(F.col("score") >= QUALITY_CUT).select("row.*")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least doc_id, of each group of near duplicates."""
    return simhash.keep_one_of_each_group(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of PASSAGE bytes that occur more than once; ``n_chars`` is
    counted anew."""
    cut = substrings.without_repeats(docs, length=PASSAGE)
    kind = docs.schema["n_chars"].dataType
    return cut.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the probabilities that rake source, language and topic to their targets."""
    return mixing.sample(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, packed into sequences."""
    return packing.pack(docs, *vocabulary())


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("suffix-array dedup", repeats_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SimHash fingerprints, the classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary_tables():
            docs = keep_table(materialize(stage(spark, before, sf_dir), name.split()[0].lower()))
        discard(before)
        before = docs
    return docs
