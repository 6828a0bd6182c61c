"""Reproducible samples and paired re-measurement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: str, seed: int) -> Column:
    """A reproducible order of keys."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"/{seed}")))


def sample(rows: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """n rows or all, by a seeded hash of the key (a top-k)."""
    return rows.orderBy(draw(key, seed), key).limit(n)


def stratified(rows: DataFrame, key: str, stratum: str, sizes: dict[str, int], seed: int = 7) -> DataFrame:
    """The named number of rows of each stratum; strata that aren't named have none.

    The largest number bounds every stratum's rows before they are shuffled:
    tasks keep so many each, however large a stratum is.
    """
    quota = F.lit(0)
    for name, n in sizes.items():
        quota = F.when(F.col(stratum) == name, n).otherwise(quota)
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(draw(key, seed), key))
    few = rows.where(F.col(stratum).isin(list(sizes))).withColumn("_n", nth).where(F.col("_n") <= max(sizes.values(), default=0))
    return few.where(F.col("_n") <= quota).drop("_n")


def changed_with_controls(before: DataFrame, after: DataFrame, key: str, digest: str, controls: int = 12) -> DataFrame:
    """key, kind: keys whose digest changed, and the first unchanged ones as controls."""
    joined = before.select(key, F.col(digest).alias("_old")).join(after.select(key, F.col(digest).alias("_new")), key)
    changed = joined.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key, F.lit("changed").alias("kind"))
    same = joined.where(F.col("_old").eqNullSafe(F.col("_new"))).orderBy(key).limit(controls).select(key, F.lit("control").alias("kind"))
    return changed.unionByName(same)


def degraded(text: Column) -> Column:
    """Digits swapped as a scanner would."""
    return F.translate(text, "710938", "170693")
