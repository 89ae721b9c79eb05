"""A training corpus from raw documents: each stage reads what the one before it kept.

``STAGES`` lists names and functions; each takes the session, the documents so far and the scale folder, and returns the
documents that it keeps (the last: their token ids). ``run`` applies them one after the other to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import bpe, langid, mixing, quality, simhash
from tideline.session import materialize

#: Models, fingerprints and token ids cannot be told in SQL; tests hold the stages against plain loops.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or without a clear language."""
    return langid.accepted(docs, langid.fit(docs))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or fall below the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.kept_rows(docs, quality.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out whole documents so that sources come near their target weights."""
    return mixing.mixed_documents(docs)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of the text decoded from them."""
    return bpe.encode_and_decode(docs, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("simhash_near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
