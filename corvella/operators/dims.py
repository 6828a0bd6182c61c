"""Lookups in small dimension tables of fixed size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tier_of(value: Column, tiers: list[tuple[float, str]]) -> Column:
    """Name of the highest tier whose threshold the value reaches, or null. tiers: (threshold, name)."""
    out = F.lit(None).cast("string")
    for least, name in sorted(tiers):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return out


def tier_gaps(value: Column, thresholds: list[float]) -> Column:
    """array of struct(threshold, passed, gap) over all thresholds; a passed one has gap 0."""
    return F.transform(F.array(*map(F.lit, thresholds)), lambda t: F.struct(t.alias("threshold"), (value >= t).alias("passed"), F.greatest(t - value, F.lit(0)).alias("gap")))


def lookup(rows: DataFrame, key: str, dim: DataFrame, dim_key: str, value: str, default: str) -> DataFrame:
    """rows with the dimension's value, the default where it has none."""
    joined = rows.join(dim.select(F.col(dim_key).alias("_k"), F.col(value).alias("_v")), F.col(key) == F.col("_k"), "left")
    return joined.withColumn(value, F.coalesce("_v", F.lit(default))).drop("_k", "_v")


def transposed(matrix: DataFrame, row: str, columns: list[str]) -> DataFrame:
    """column, entries: for each column the (row, value) pairs with a value, by row."""
    long = matrix.unpivot([row], columns, "column", "value").where("value IS NOT NULL")
    return long.groupBy("column").agg(F.array_sort(F.collect_list(F.struct(row, "value"))).alias("entries"))
