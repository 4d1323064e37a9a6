"""Corpus pipeline: quality rules, near copies, decontamination, personal data, packing.

Each stage reads what the one before wrote and keeps the columns of ``documents`` (the last one
returns the packed pieces). Empty tables give empty results; null texts fail the quality rules.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nodeloom.llm import contamination, nearcopies, packing, pii, quality
from nodeloom.plans.store import save

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality cascade rejects."""
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the least id, of each class of exact and near copies."""
    return nearcopies.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that are contaminated with benchmark items."""
    return contamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in the texts; ``n_chars`` follows the new text."""
    return pii.mask(docs, size="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents into token sequences; one row per piece."""
    return packing.report(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("near copies", near_copies),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", pack),
]

#: Tokenisation cannot be expressed in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written, read again, and dropped once the next are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        held = save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        if before:
            before.drop()
        docs, before = held.df, held
    return docs
