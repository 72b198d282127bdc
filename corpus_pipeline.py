"""The training-data pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; ``run`` writes each stage's rows to the shared scratch folder and reads
them again as the next stage's documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsight.llm import mixing, pii, quality, sentencepiece, simhash
from tabsight.llm.common import load, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the default rule policy keeps."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash group (3-word shingles, 3 bits)."""
    return simhash.one_per_group(docs, shingle=3, max_bits=3)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind in brackets."""
    return pii.redacted(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them, in mix order."""
    return mixing.mixed_documents(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every row."""
    coded = sentencepiece.encode(docs, keep=["doc_id", "lang", "source", "n_chars"])
    return coded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

# The stages use XXH64 fingerprints, a trained span classifier and a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
