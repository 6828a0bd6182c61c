"""Snapshot comparison and mirror plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, status: new, gone, changed or ok."""
    b, a = before.select(F.col(key).alias("_b"), F.col(digest).alias("_old")), after.select(F.col(key).alias("_a"), F.col(digest).alias("_new"))
    status = F.when(F.col("_b").isNull(), "new").when(F.col("_a").isNull(), "gone").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed").otherwise("ok")
    return b.join(a, F.col("_b") == F.col("_a"), "full_outer").select(F.coalesce("_b", "_a").alias(key), status.alias("status"))


def mirror_plan(source: DataFrame, mirror: DataFrame, key: str, size: str) -> DataFrame:
    """key, action: copy where the mirror lacks it or has another size, delete where the source is gone. Kept files have no row."""
    s, m = source.select(F.col(key).alias("_s"), F.col(size).alias("_n")), mirror.select(F.col(key).alias("_m"), F.col(size).alias("_o"))
    action = F.when(F.col("_s").isNull(), "delete").when(F.col("_m").isNull() | (F.col("_n") != F.col("_o")), "copy")
    return s.join(m, F.col("_s") == F.col("_m"), "full_outer").select(F.coalesce("_s", "_m").alias(key), action.alias("action")).where("action IS NOT NULL")


def path_sets(before: DataFrame, after: DataFrame, path: str) -> DataFrame:
    """path, side: added, dropped or kept."""
    b, a = before.select(path).distinct(), after.select(path).distinct()
    sides = b.withColumn("b", F.lit(1)).unionByName(a.withColumn("a", F.lit(1)), allowMissingColumns=True)
    both = sides.groupBy(path).agg(F.max("b").alias("b"), F.max("a").alias("a"))
    return both.select(path, F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "dropped").otherwise("kept").alias("side"))


def rebased(baseline: DataFrame, snapshot: DataFrame, key: str, healthy: str = "healthy") -> DataFrame:
    """The next baseline: healthy pages from the snapshot, all others as they were."""
    good = snapshot.where(healthy)
    return good.select(*baseline.columns).unionByName(baseline.join(good, key, "left_anti"))


def content_dedupe(rows: DataFrame, text: str, order: str) -> DataFrame:
    """text_sha1, the first row's `order` value and the number of copies, for each distinct text."""
    return rows.select(order, F.sha1(text).alias("text_sha1")).groupBy("text_sha1").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies"))
