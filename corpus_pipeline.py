"""From raw documents to a training mix: each stage calls one operator of ``gridloom.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written and read again as
the next stage's ``docs``.  All stages but the last return the columns of ``docs``; the last returns the
mix: ``doc_id, source, size, source_size, target, taken`` of every document from which words are taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import dart_minhash, decontaminate, line_dedup, mixing, quality_classifier
from gridloom.llm.text import prepare
from gridloom.session import cut_lineage

#: Score from which a document is kept.
GOOD = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score, learned from the labelled ones among them, reaches the threshold.

    Nulls: a null text is scored as an empty one; no labels, nothing is rejected.
    """
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.keep_good(docs, quality_classifier.learn(docs, labels), GOOD)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document has, exactly or within two edits."""
    prepare(spark)
    return line_dedup.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    prepare(spark)
    return dart_minhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: documents from which words are taken, and how many."""
    prepare(spark)
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("minhash near-dedup", dedup_documents),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: A trained classifier comes first, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
