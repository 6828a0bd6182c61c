"""Conversation histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trimmed(turns: DataFrame, most: int = 12, drop: int = 6) -> DataFrame:
    """The last turns of each conversation: blocks of `drop` go from the front while over `most` are left, then all before the first user turn."""
    conv = Window.partitionBy("conv_id")
    nth = F.row_number().over(conv.orderBy("turn"))
    n = F.count(F.lit(1)).over(conv)
    gone = F.lit(drop) * F.ceil(F.greatest(n - most, F.lit(0)) / drop)
    kept = turns.withColumn("_nth", nth).withColumn("_gone", gone).where("_nth > _gone")
    first = F.min(F.when(F.col("role") == "user", F.col("_nth"))).over(conv)
    return kept.withColumn("_first", first).where("_nth >= _first").drop("_nth", "_gone", "_first")


def with_question(turns: DataFrame) -> DataFrame:
    """Assistant turns with the last user text before them."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before)
    return turns.withColumn("question", asked).where("role = 'assistant'")


def archive(turns: DataFrame, keep: int = 10) -> DataFrame:
    """conv_id, title, n_turns of the newest conversations (largest id); the title is the first user text's first 40 characters."""
    per = turns.groupBy("conv_id").agg(F.substring(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))), 1, 40).alias("title"), F.count(F.lit(1)).alias("n_turns"))
    return per.orderBy(F.desc("conv_id")).limit(keep)


def transcript(turns: DataFrame) -> DataFrame:
    """conv_id, context: `[role] text` of all turns in order, between rules."""
    line = F.concat(F.lit("["), "role", F.lit("] "), "text")
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n---\n\n").alias("context"))
