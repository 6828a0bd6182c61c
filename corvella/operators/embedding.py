"""Embeddings: pooling, a cache of vectors by text, and the interface of embedders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.functions import vectors

#: An embedder turns texts (text_sha1, text) into vectors (text_sha1, vector).
Embedder = Callable[[DataFrame], DataFrame]


def pooled(tokens: DataFrame, key: str) -> DataFrame:
    """key, vector: the mean of token vectors (key, vector) of one length each, scaled to length 1."""
    parts = tokens.select(key, F.posexplode("vector").alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select(key, vectors.unit(F.transform("v", lambda p: p["x"])).alias("vector"))


def hashed_words(size: int = 64) -> Embedder:
    """An embedder without a model: signed word counts in `size` hashed slots, scaled to length 1."""

    def embed(texts: DataFrame) -> DataFrame:
        from corvella.functions import text as T

        rows = texts.select("text_sha1", F.explode(T.words(F.lower("text"))).alias("word"))
        slot, sign = F.pmod(F.xxhash64("word"), F.lit(size)).cast("int"), F.when(F.pmod(F.xxhash64(F.lit(1), "word"), F.lit(2)) == 0, 1.0).otherwise(-1.0)
        sums = rows.groupBy("text_sha1", slot.alias("i")).agg(F.sum(sign).alias("x")).groupBy("text_sha1").agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
        full = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
        return texts.join(sums, "text_sha1", "left").select("text_sha1", vectors.unit(full).alias("vector"))

    return embed


def embedded(texts: DataFrame, cache: DataFrame, embed: Embedder, model: str) -> tuple[DataFrame, DataFrame]:
    """text_sha1, vector of all distinct texts, and the new cache rows (text_sha1, model, vector) to append.

    Only texts that the cache lacks for the model are embedded.
    """
    keyed = texts.where("text IS NOT NULL").select("text", F.sha1("text").alias("text_sha1")).dropDuplicates(["text_sha1"])
    known = cache.where(F.col("model") == model).select("text_sha1", "vector")
    new = embed(keyed.join(known, "text_sha1", "left_anti").select("text_sha1", "text"))
    have = known.join(keyed.select("text_sha1"), "text_sha1", "left_semi")
    return have.unionByName(new.select("text_sha1", "vector")), new.select("text_sha1", F.lit(model).alias("model"), "vector")


def append_cache(new: DataFrame, path: str) -> None:
    """Appends new cache rows."""
    new.write.mode("append").partitionBy("model").parquet(path)
