"""A corpus made ready for training: five stages, each working on all that the one before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each result as
Parquet to the shared scratch folder and reads it back as the next stage's documents.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftgate.llm import bpe, decontamination, language, near_dedup, secrets
from siftgate.llm.common import table, written
from siftgate.llm.queries import TIKTOKEN_RANKS


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents for which the mixture of languages, learned from ``lang``, has no name: those without a letter."""
    return language.known_only(docs, language.learn(docs))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    return near_dedup.representatives(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of the benchmark; drop documents that they mostly make up."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets, those in encoded layers too."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source`` with the ids, and the hashes that show that they decode to the text."""
    path = public_tokenizers.path(TIKTOKEN_RANKS)
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], with_ids=True)


STAGES = [
    ("language", known_languages),
    ("near_dedup", distinct_texts),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: None of the stages but the removal of letterless texts can be said in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), os.path.join("pipeline", name))
    return docs
