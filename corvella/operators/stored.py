"""Intermediate tables and order statistics that no single task has to hold."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_SENT = 64 << 20  # bytes that a checked table may have to be broadcast
MOST_IN_A_TASK = 1_000_000  # distinct values that one window may order


def stored(df: DataFrame) -> DataFrame:
    """df written once to the session's spark.checkpoint.dir, so that later uses read it. Only on one machine a temporary folder stands in."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least as many partitions as there are cores; tables of more splits are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def sent_if_small(df: DataFrame, *texts: str, most_bytes: int = MOST_SENT) -> DataFrame:
    """df to be broadcast if its rows and text columns take most_bytes at most; else left to a shuffle join."""
    size = df.agg(F.sum(F.lit(32) + sum((F.octet_length(c) for c in texts), F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if size <= most_bytes else df


def values_at(values: DataFrame, column: str, places: Callable[[int], list[int]], most: int = MOST_IN_A_TASK) -> DataFrame:
    """place, value: the values at 0-based places of the sorted column, nulls left out; places: from their number.

    Distinct values are counted first. While more than `most` of them may be
    the one at a place, 64 cuts narrow the range, so that a window orders a
    bounded number of values only. No values, no rows.
    """
    counts = stored(values.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("times")))
    n, kinds = counts.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count(F.lit(1))).first()
    found = None
    for place in sorted(set(places(n))) if n else []:
        part, base, size = counts, 0, kinds
        while size > most:
            cuts = sorted(set(part.agg(F.percentile_approx("value", [i / 64 for i in range(1, 64)], 1000)).first()[0]))
            upto = part.agg(*[F.coalesce(F.sum(F.when(F.col("value") <= c, F.col("times"))), F.lit(0)) for c in cuts]).first()
            over = next((i for i, u in enumerate(upto) if base + u > place), len(cuts))
            if over:
                part, base = part.where(F.col("value") > cuts[over - 1]), base + upto[over - 1]
            if over < len(cuts):
                part = part.where(F.col("value") <= cuts[over])
            last, size = size, part.count()
            if size == last:
                break
        upto = F.lit(base) + F.sum("times").over(Window.orderBy("value"))
        one = part.withColumn("upto", upto).where(F.col("upto") > place).agg(F.min("value").alias("value")).select(F.lit(place).cast("long").alias("place"), "value")
        found = one if found is None else found.unionAll(one)
    return found if found is not None else counts.select(F.lit(0).cast("long").alias("place"), "value").limit(0)


def quantiles(values: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """share, value: exact quantiles with linear interpolation between neighbours."""
    n = values.where(F.col(column).isNotNull()).count()
    at = [(s, (n - 1) * s) for s in shares] if n else []
    told = values_at(values, column, lambda _: [int(x) + k for _, x in at for k in (0, 1) if int(x) + k < n])
    wanted = values.sparkSession.createDataFrame([(s, int(x), min(int(x) + 1, n - 1), x - int(x)) for s, x in at], "share double, low long, high long, part double")  # a row a share
    low, high = (told.select(F.col("place").alias(f"p{k}"), F.col("value").cast("double").alias(f"v{k}")) for k in (0, 1))
    joined = wanted.join(low, F.col("low") == F.col("p0")).join(high, F.col("high") == F.col("p1"))
    return joined.select("share", (F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")).alias("value"))
