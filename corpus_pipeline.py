"""Corpus pipeline: five stages over documents, each written as Parquet and reread as the next one's docs.

1 quality rules: documents that fail the base rules or that an isolation forest rejects go.
2 SimHash near-dedup: one document of each group of near-duplicates stays, the one with the smallest id.
3 benchmark decontamination: documents that share a window of words with a benchmark item go.
4 PII: personal data and disclosive terms are replaced in the text; all documents stay.
5 byte-level BPE: every text is encoded and decoded; returns the digests of both.

Rows are carried whole: a repeated row is judged like its twin, and near-dedup keeps one of all. Null texts fail the
quality rules. Columns beyond those of documents pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docintake.llm import bpe, decontam, pii, rules_iforest, simhash
from docintake.llm.common import removed, stored
from docintake.llm.queries import public_vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rules_iforest.passing(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(docs, *public_vocabulary())


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("PII", sanitise),
    ("byte-level BPE encoding and decoding", encode),
]

#: Forests and BPE cannot be said in SQL; tests hold the stages against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written to the shared folder before the next one reads it, and deleted after that."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            removed(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
