"""Text gates: grounding, mirroring of evaluation texts, OCR noise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.functions import text as T

from .stored import sent_if_small


def stems(text: Column) -> Column:
    """Distinct folded words of three letters or more without marks."""
    return F.array_distinct(F.filter(F.transform(T.words(text), lambda w: F.lower(T.bare(w))), lambda w: F.length(w) >= 3))


def mirrors(texts: DataFrame, held: DataFrame, least: float, stems: Callable[[Column], Column] = stems) -> DataFrame:
    """id, other, jaccard of texts whose stem set is as close as `least` to a held one.

    A pair that close shares one of the (1 - least) * n + 1 rarest stems of
    either set, so sets meet by an equi-join of those prefixes. Stems are rare
    by their count among the held texts. Texts that are partitioned by id are
    not shuffled for it while the held stems are few enough to be sent.
    """
    a = texts.select("id", stems(F.col("text")).alias("s")).where(F.size("s") > 0)
    b = held.select(F.col("id").alias("other"), stems(F.col("text")).alias("t")).where(F.size("t") > 0)
    counts = sent_if_small(b.select(F.explode("t").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")), "w")

    def prefix(df: DataFrame, key: str, column: str) -> DataFrame:
        # Stems that no held text has come first in the order and match nothing: only the others are ranked.
        size = F.size(column).alias("size")
        ranked = df.select(key, size, F.explode(column).alias("w")).join(counts, "w").groupBy(key, "size").agg(F.array_sort(F.collect_list(F.struct("n", "w"))).alias("r"))
        keep = F.size("r") - F.ceil(F.col("size") * least - 1e-9) + 1
        return ranked.where(keep > 0).select(key, F.explode(F.slice("r", F.lit(1), keep.cast("int"))).alias("p")).select(key, F.col("p.w").alias("w"))

    pairs = prefix(a, "id", "s").join(prefix(b, "other", "t"), "w").select("id", "other").distinct()
    # Stems again only of texts that met one.
    joined = pairs.join(texts.select("id", "text"), "id").select("id", "other", stems(F.col("text")).alias("s")).join(b, "other")
    jaccard = F.size(F.array_intersect("s", "t")) / F.size(F.array_union("s", "t"))
    return joined.select("id", "other", F.round(jaccard, 6).alias("jaccard")).where(jaccard >= least)


def ungrounded_share(candidates: DataFrame, source_words: DataFrame) -> DataFrame:
    """id, n_words, n_ungrounded, share of each candidate's distinct stems that the source vocabulary (word) lacks."""
    rows = candidates.select("id", F.explode_outer(stems(F.col("text"))).alias("word"))
    known = source_words.select("word").distinct().withColumn("known", F.lit(1))
    joined = rows.join(known, "word", "left")
    out = joined.groupBy("id").agg(F.count("word").alias("n_words"), F.count_if(F.col("word").isNotNull() & F.col("known").isNull()).alias("n_ungrounded"))
    return out.withColumn("share", F.round(F.col("n_ungrounded") / F.greatest(F.col("n_words"), F.lit(1)), 6))


def ocr_rate(docs: DataFrame) -> DataFrame:
    """doc_id, glued, per_thousand: letters and digits stuck together, per thousand words."""
    glued = F.size(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]"), F.lit(0)))
    n = F.size(T.words(F.col("text")))
    return docs.select("doc_id", glued.alias("glued"), F.round(F.lit(1000.0) * glued / F.greatest(n, F.lit(1)), 6).alias("per_thousand"))


def structure_audit(docs: DataFrame) -> DataFrame:
    """Counts and flags of each document (document_id, title, raw_text, sections, anchor_questions)."""
    n_clauses = F.aggregate(F.transform("sections", lambda s: F.size(s["clauses"])), F.lit(0), lambda a, x: a + x)
    return docs.select(
        "document_id", F.size("sections").alias("n_sections"), n_clauses.alias("n_clauses"), F.size(T.words(F.col("raw_text"))).alias("n_words"),
        F.coalesce(F.size("anchor_questions"), F.lit(0)).alias("n_anchors"), F.exists("sections", lambda s: F.startswith(s["id"], F.lit("key-facts"))).alias("has_key_facts"),
    )
