"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import shared


SALTS = 16


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Points each neighbour of a node (larger ones, or smaller ones and itself) at the least of them.

    The least neighbour is an aggregate joined back on (hub, salt of the
    neighbour), so a hub's neighbours are spread over SALTS tasks.
    """
    if larger:
        edges = edges.union(edges.select("b", "a"))
    least = edges.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("low"))
    least = least.select("hub", F.least("hub", "low").alias("low"))
    salts = F.explode(F.array(*map(F.lit, range(SALTS))))
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    joined = salted.join(least.select("hub", "low", salts.alias("of")), (F.col("a") == F.col("hub")) & (F.col("salt") == F.col("of")))
    if larger:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    other = joined.select(F.col("b").alias("a"), F.col("low").alias("b"))
    return other.union(least.select(F.col("hub").alias("a"), F.col("low").alias("b"))).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node of links (a, b).

    Large-star and small-star rounds alternate until the table stops changing;
    the rounds grow with the logarithm of the longest chain. Each round is
    written to the shared checkpoint folder.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = shared(links.where("a <> b").select(high.alias("a"), low.alias("b")).distinct())
    state = None
    while True:
        now = tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.expr("bit_xor(xxhash64(b, a, 1))")).first())
        if now == state or not now[0]:
            break
        state = now
        edges = shared(_stars(_stars(edges, True), False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
