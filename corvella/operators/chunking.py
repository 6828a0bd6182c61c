"""Chunk rows of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvella.functions import text as T

SIZE, STEP = 180, 140


def chunk_windows(docs: DataFrame, size: int = SIZE, step: int = STEP, title: str = "source") -> DataFrame:
    """doc_id, chunk_ord, chunk_id, body, text: overlapping word windows; one starts every `step` words.

    Documents without words have none. A projection: no shuffle. A text is
    split once and sliced into bodies, so a row carries its own body only.
    """
    bodies = F.transform(F.array(T.words(F.col("text"))), lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(0), F.size(w) - 1, F.lit(step)), lambda at: F.array_join(F.slice(w, at + 1, size), " "))))
    rows = docs.select("doc_id", F.col(title).alias("title"), F.posexplode(F.element_at(bodies, 1)).alias("at", "body"))
    ordinal = F.col("at").cast("long")
    return rows.select("doc_id", ordinal.alias("chunk_ord"), F.concat(F.col("doc_id").cast("string"), F.lit("__chunk"), ordinal.cast("string")).alias("chunk_id"), "body", F.concat("title", F.lit("\n"), "body").alias("text"))


def clause_rows(docs: DataFrame) -> DataFrame:
    """id, doc_id, section, clause, text of the non-blank clauses of docs (document_id, title, sections)."""
    s = docs.select("document_id", "title", F.explode("sections").alias("s")).select("document_id", "title", "s.id", F.col("s.title").alias("section"), F.explode("s.clauses").alias("c"))
    label = F.concat(F.lit("clause "), F.col("c.number"), F.lit(": "))
    return s.where(F.trim("c.text") != "").select(
        F.concat("document_id", F.lit("__s"), "id", F.lit("__c"), "c.number").alias("id"),
        F.col("document_id").alias("doc_id"), F.col("id").alias("section"), F.col("c.number").alias("clause"),
        F.concat("title", F.lit(" — "), "section", F.lit("\n"), label, "c.text").alias("text"),
    )


def anchor_rows(questions: DataFrame, least: int = 12) -> DataFrame:
    """id, doc_id, text of anchor questions (doc_id, questions array): first of repeated ones, numbered before short ones go."""
    rows = questions.select("doc_id", F.posexplode(F.array_distinct("questions")).alias("i", "text"))
    return rows.where(F.length("text") >= least).select(F.concat(F.col("doc_id").cast("string"), F.lit("__sq"), F.col("i").cast("string")).alias("id"), "doc_id", "text")


def latest(rows: DataFrame, key: list[str], version: list[str]) -> DataFrame:
    """The newest row of each key (upsert by key)."""
    order = Window.partitionBy(*key).orderBy(*[F.desc_nulls_last(v) for v in version])
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def carried_forward(new: DataFrame, old: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """new with the fields that its previous version has already."""
    before = old.select(F.col(key).alias("_k"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = new.join(before, new[key] == F.col("_k"), "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else new[c] for c in new.columns])
