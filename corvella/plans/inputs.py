"""How operators are bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.operators import dense
from corvella.operators.stored import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Columns of documents, spread over the cores where the file has fewer splits."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", *columns), "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All embeddings as rows, and those whose id is divisible by 100 as queries."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), "embedding", F.col("label").alias("doc_id"))
    return rows, rows.where("row_id % 100 = 0").select(F.col("row_id").alias("query_id"), "embedding")


def section() -> Column:
    """What the remainder of a row's id stands for."""
    return F.when(F.col("row_id") % 3 == 0, "sq").when(F.col("row_id") % 3 == 1, "key-facts").otherwise("chunk")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row scored for every query; the label stands for the document and the id's remainder for the section."""
    rows, queries = vectors(spark, sf_dir)
    return dense.pair_scores(rows, queries, also=("doc_id",)).withColumn("section", section())


def best_hits(spark: SparkSession, sf_dir: str, keep: int, sections: bool = False, budget: int | None = None) -> DataFrame:
    """Of hits the `keep` best of each query and document, or with sections of each of their sections, and others that tasks could not rule out. budget: for each document also the best curated rows while their words (a row has as many as its id has units), the first's left out, stay in it."""
    rows, queries = vectors(spark, sf_dir)
    # Only curated rows count against a budget: of others the first ones will do.
    size = F.when(section() == "key-facts", F.col("row_id") % 10).otherwise(F.lit((budget or 0) + 1)).cast("long")
    rows = rows.withColumns({"section": section(), "n_words": size})
    found = dense.best_pairs(rows, queries, keep, ("doc_id", "section") if sections else ("doc_id",), words=None if budget is None else "n_words", budget=budget or 0)
    return found.withColumn("section", section()).select("row_id", "query_id", "score", "doc_id", "section")


HITS_SQL = """hits AS (SELECT q.vec_id AS query_id, c.vec_id AS row_id, c.label AS doc_id,
    CASE c.vec_id % 3 WHEN 0 THEN 'sq' WHEN 1 THEN 'key-facts' ELSE 'chunk' END AS section,
    round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 3) AS score
  FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)"""

WINDOWS_SQL = r"""doc_words AS (SELECT doc_id, source, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words FROM documents),
window_starts AS (SELECT doc_id, source, words, unnest(range(0, len(words), 140)) AS nth FROM doc_words),
windows AS (SELECT doc_id, nth // 140 AS chunk_ord, doc_id || '__chunk' || (nth // 140) AS chunk_id, array_to_string(words[nth + 1 : nth + 180], ' ') AS body,
  source || chr(10) || array_to_string(words[nth + 1 : nth + 180], ' ') AS text FROM window_starts)"""
