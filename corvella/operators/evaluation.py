"""Gates, bands, rates and paired comparisons of retrieval runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvella.functions import amounts

from .stored import values_at


def band(score: Column, hit: Column, green: float, red: float) -> Column:
    """green: score reaches it and the target wasn't missed; red: below; else yellow."""
    return F.when((score >= green) & ~hit.eqNullSafe(F.lit(False)), "green").when(score < red, "red").otherwise("yellow")


def gate_counts(cases: DataFrame, by: str) -> DataFrame:
    """passed and total of each value of `by`, and over all (null). cases: by, ok."""
    return cases.rollup(by).agg(F.count_if("ok").alias("passed"), F.count(F.lit(1)).alias("total"))


def band_table(cases: DataFrame) -> DataFrame:
    """source, green, yellow, red counts."""
    return cases.groupBy("source").pivot("band", ["green", "yellow", "red"]).agg(F.count(F.lit(1))).na.fill(0)


def stratified_rate(sample: DataFrame, population: DataFrame) -> DataFrame:
    """outcome, rate: outcome shares of each stratum's sample weighted by the stratum's share of the population."""
    shares = population.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    total = population.agg(F.count(F.lit(1)).alias("total"))
    n = sample.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    got = sample.groupBy("stratum", "outcome").agg(F.count(F.lit(1)).alias("k"))
    parts = got.join(n, "stratum").join(shares, "stratum").join(F.broadcast(total))  # total: one row
    return parts.groupBy("outcome").agg(F.round(F.sum(F.col("k") / F.col("n") * F.col("size") / F.col("total")), 6).alias("rate"))


def unmeasured(sample: DataFrame, population: DataFrame) -> DataFrame:
    """stratum, size, share of the strata that stratified_rate counts with 0, as the sample holds none of them."""
    shares = population.groupBy("stratum").agg(F.count(F.lit(1)).alias("size"))
    total = population.agg(F.count(F.lit(1)).alias("total"))
    missing = shares.join(sample.select("stratum").distinct(), "stratum", "left_anti")
    return missing.join(F.broadcast(total)).select("stratum", "size", F.round(F.col("size") / F.col("total"), 6).alias("share"))  # total: one row


def with_wilson(counts: DataFrame, hits: str, n: str) -> DataFrame:
    low, high = amounts.wilson(F.col(hits), F.col(n))
    return counts.withColumns({"low": F.round(low, 6), "high": F.round(high, 6)})


def flips(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """before, after, n over keys in both."""
    joined = before.select(key, F.col("outcome").alias("before")).join(after.select(key, F.col("outcome").alias("after")), key)
    return joined.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))


def positional_quantile(values: DataFrame, column: str, tenth: int) -> DataFrame:
    """The value at index n * tenth div 10 of the sorted values."""
    return values_at(values, column, lambda n: [n * tenth // 10]).select("value")


def best_in_group(pairs: DataFrame, group: list[str], item: str, score: str) -> DataFrame:
    """The item of the best score in each group; equal scores: the smallest item."""
    return pairs.groupBy(*group).agg(F.max(F.struct(score, (-F.col(item)).alias("r"))).alias("m")).select(*group, (-F.col("m.r")).alias(item), F.col(f"m.{score}").alias(score))
