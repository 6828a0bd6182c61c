"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, all
columns unchanged in kind; the last returns token counts and digests. Stages
pass null ids, further columns of any name and empty tables on. What they do
with null and empty texts and with repeated rows stands with each; all read very
long texts whole, alone in their chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvella.llm import decontaminate, langid, queries, simhash, substring
from corvella.llm.cluster import shared, small_batches, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null texts, texts without a letter, low scores. Repeated rows stay or go together."""
    small_batches(spark)
    return langid.keep_known(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id (null ids last) of each near-duplicate group, one row of repeated ones. Null and empty texts are one group."""
    small_batches(spark)
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts words that repeated windows cover, and drops what is emptied so. Null, empty and short texts stay as they are."""
    small_batches(spark)
    return substring.remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item. Null and empty texts leak none."""
    small_batches(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left; null and empty texts have no tokens, repeated rows come back repeated."""
    small_batches(spark)
    return queries.token_digests(docs, queries.vocabulary_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
