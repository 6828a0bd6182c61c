"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Every row gets a number 0 .. N-1. A keyed permutation of that range gives the
row's place in the shuffled order; the place modulo the shard count is the
shard and the quotient the slot, so both can be computed from the row number
alone and shard sizes differ by at most one (law ``rows``).

The permutation is an alternating Feistel network on a grid of a x b >= N
cells. Values outside 0 .. N-1 are walked on along their cycle. A walk visits
each outside cell once at most, so a*b - N further steps always suffice; a is
chosen so that this is a handful.

Only DataFrame functions run. Texts are never shuffled: identical keys are
counted first, and a group of any size is dealt over blocks in parts of
ROWS_PER_BLOCK copies.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import byte_length, shared

ROWS_PER_BLOCK = 50_000  # or the root of the rows where that is more, so that blocks and rows a block grow alike
ROUNDS = 6


def grid(n: int, tries: int = 65_536) -> tuple[int, int]:
    """(a, b) near the square root of n with a * b >= n and least to spare."""
    root = math.isqrt(max(n, 1) - 1) + 1
    best = min(range(root, max(0, root - tries, root // 2), -1), key=lambda a: (-n % a, root - a), default=1)
    return best, -(-n // best)


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """A permutation of 0 .. a*b - 1; the halves are a cell's row and column in the grid."""
    right = F.pmod(x, F.lit(b)).cast("long")
    left = ((x - right) / F.lit(b)).cast("long")
    for r in range(ROUNDS):
        key = F.lit(seed * 64 + r).cast("long")
        if r % 2 == 0:
            left = F.pmod(left + F.pmod(F.xxhash64(right, key), F.lit(a)), F.lit(a))
        else:
            right = F.pmod(right + F.pmod(F.xxhash64(left, key), F.lit(b)), F.lit(b))
    return (left * F.lit(b) + right).cast("long")


def shuffled_place(row_number: Column, n: int, seed: int) -> Column:
    """The place of a row number in the keyed shuffle of 0 .. n-1."""
    a, b = grid(n)
    place, spare = feistel(row_number, a, b, seed), a * b - n
    if not spare:
        return place
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(spare)), place, lambda at, _: F.when(at < n, at).otherwise(feistel(at, a, b, seed)))
    return F.when(place < n, place).otherwise(walked)


def number_rows(rows: DataFrame, key: list[str]) -> tuple[DataFrame, int]:
    """Adds row_number, 0 .. N-1, in the order of (hash block, key), and gives N.

    The numbering depends on the rows alone, not on files or partitions. Rows
    alike in every key column are interchangeable.
    """
    groups = shared(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")))
    n = groups.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    blocks = max(1, -(-n // max(ROWS_PER_BLOCK, math.isqrt(n))))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / ROWS_PER_BLOCK)))
    parts = groups.select(*key, "copies", part.alias("part")).withColumn("copies", F.least(F.lit(ROWS_PER_BLOCK), F.col("copies") - F.col("part") * ROWS_PER_BLOCK))
    parts = parts.withColumn("block", F.pmod(F.xxhash64(*key, "part"), F.lit(blocks)))
    sizes = parts.groupBy("block").agg(F.sum("copies").alias("held"))
    offsets = sizes.select("block", (F.sum("held").over(Window.orderBy("block")) - F.col("held")).alias("offset"))
    before = F.sum("copies").over(Window.partitionBy("block").orderBy(*[F.asc_nulls_first(k) for k in key], "part")) - F.col("copies")
    # offsets has a row a block: the root of the rows at most.
    placed = parts.withColumn("before", before).join(F.broadcast(offsets), "block")
    first = F.col("offset") + F.col("before")
    return placed.select(*key, F.explode(F.sequence(first, first + F.col("copies") - 1)).alias("row_number")), n


def assign_shards(docs: DataFrame, shards: int = 8, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard, slot of every row of docs.

    size: UTF-8 bytes of the text plus 1. Null texts count as empty (size 1,
    checksum 0), null ids are ordinary values that sort first, repeated rows
    each get a place of their own, an empty table gives no rows. Other columns
    of docs are ignored, whatever their names. Of very long texts only size and
    checksum go on.
    """
    rows = docs.select(
        F.col("doc_id"),
        (byte_length(F.col("text")) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")).alias("text_crc32"),
    )
    numbered, n = number_rows(rows, ["doc_id", "size", "text_crc32"])
    placed = numbered.withColumn("place", shuffled_place(F.col("row_number"), max(n, 1), seed))
    shard = F.pmod(F.col("place"), F.lit(shards))
    return placed.select("doc_id", "size", "text_crc32", "row_number", shard.cast("int").alias("shard"), ((F.col("place") - shard) / shards).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 20, slots_per_file: int = 100_000) -> None:
    """Writes docs to path/shard=k in slot order, in files of slots_per_file rows.

    Null ids and texts are written as they are, repeated rows each once for
    each time they occur; an empty table writes no shard; only doc_id and text
    of docs are written.
    """
    places = assign_shards(docs, shards, seed).dropDuplicates(["doc_id", "size", "text_crc32", "slot", "shard"]).select(
        *[F.col(c).alias(f"_{c}") for c in ("doc_id", "size", "text_crc32")], "shard", "slot"
    )
    order = Window.partitionBy("_doc_id", "_size", "_text_crc32").orderBy("slot", "shard")
    texts = docs.select("doc_id", "text").withColumns({"_size": (byte_length(F.col("text")) + 1).cast("long"), "_text_crc32": F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))})
    texts = texts.withColumn("_copy", F.row_number().over(Window.partitionBy("doc_id", "_size", "_text_crc32").orderBy("text")))
    places = places.withColumn("_copy_", F.row_number().over(order))
    same = (texts.doc_id.eqNullSafe(places._doc_id)) & (texts._size == places._size) & (texts._text_crc32 == places._text_crc32) & (texts._copy == places._copy_)
    out = texts.join(places, same).select("doc_id", "text", "shard", "slot")
    (out.repartition(F.col("shard"), F.floor(F.col("slot") / slots_per_file)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").mode("errorifexists").parquet(path))
