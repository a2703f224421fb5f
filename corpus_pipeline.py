"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on every row that the one before it kept and
returns the columns of ``documents``; the last returns the places of packed pieces.
``run`` writes every stage as Parquet in the shared stage folder and reads it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mnemograph.llm import line_dedup, near_dedup, packing, pii, quality
from mnemograph.llm.common import documents, stage, table, tokenizer_path
from mnemograph.llm.queries import PII_KEY, WORD_BPE


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with the length column true to the text."""
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the calibrated forests keep."""
    _, model = quality.fitted(docs, table(spark, sf_dir, "labels"))
    return quality.kept_documents(docs, model)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that match an earlier one."""
    lines = line_dedup.matched_lines(docs)
    return _sized(line_dedup.without_lines(
        docs, lines.where(~F.col("kept")).select(line_dedup.PLACE)))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return near_dedup.one_of_each(docs, near_dedup.near_classes(docs))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data."""
    return _sized(pii.pseudonymized(docs, PII_KEY))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack_documents(docs, tokenizer_path(WORD_BPE), digest=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("pii", pseudonyms),
    ("packing", best_fit_packing),
]

#: Forests, similarity joins and vocabularies are beyond SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
