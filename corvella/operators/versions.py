"""Baselines in versions, and memo keys that follow a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diff import snapshot_diff


def at_version(versions: DataFrame, key: str, version: int) -> DataFrame:
    """Each key's row as of a version: the last one written up to it. versions: key, version and further columns; only what a version changed has rows."""
    rows = versions.where(F.col("version") <= version)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("r")).select(key, "r.*")


def newest_version(versions: DataFrame) -> DataFrame:
    """version: the pointer, one row; null without versions."""
    return versions.agg(F.max("version").alias("version"))


def accepted(versions: DataFrame, snapshot: DataFrame, healthy: str) -> DataFrame:
    """The rows that a snapshot adds as the next version: its healthy ones."""
    pointer = newest_version(versions).select(F.coalesce("version", F.lit(0)).alias("_v"))  # one row
    told = snapshot.where(healthy).join(F.broadcast(pointer)).withColumn("version", F.col("_v") + 1)
    return told.select(*versions.columns)


def version_diff(versions: DataFrame, key: str, digest: str, before: int, after: int) -> DataFrame:
    """key, status (new, gone, changed, ok) between any two versions."""
    return snapshot_diff(at_version(versions, key, before), at_version(versions, key, after), key, digest)


def row_number_hash(*columns: Column) -> Column:
    """52 bits of a row's md5 as a number. A null column differs from an empty one."""
    text = F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns])
    return F.conv(F.left(F.md5(text), F.lit(13)), 16, 10).cast("long")


def catalogue_digest(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by and digest: one value for all rows of a group whatever their order, from their number and the sum and xor of their hashes."""
    told = rows.select(*by, row_number_hash(*[F.col(c) for c in columns]).alias("h"))
    per = told.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(20,0)")).alias("s"), F.bit_xor("h").alias("x"))
    return per.select(*by, F.left(F.sha1(F.concat_ws("/", *[F.col(c).cast("string") for c in ("n", "s", "x")])), F.lit(12)).alias("digest"))


def memo_keys(requests: DataFrame, digests: DataFrame, group: str, question: str) -> DataFrame:
    """requests with memo_key: group, the group's digest, and the question's hash. Where the catalogue changes, all keys of its group do."""
    joined = requests.join(digests.select(F.col(group).alias("_g"), "digest"), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    key = F.concat_ws("|", F.coalesce(F.col(group), F.lit("")), F.coalesce("digest", F.lit("")), F.left(F.sha1(F.col(question)), F.lit(16)))
    return joined.withColumn("memo_key", key).drop("digest")


def memo_misses(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct memo keys that the cache (memo_key, answer) lacks, each with one of its requests."""
    missing = keyed.join(cache.select("memo_key"), "memo_key", "left_anti")
    return missing.dropDuplicates(["memo_key"])


def memo_merged(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with new answers (memo_key, answer); what it has already stays, so writers that meet agree."""
    both = cache.select("memo_key", "answer", F.lit(0).alias("_o")).unionByName(answers.select("memo_key", "answer", F.lit(1).alias("_o")))
    return both.groupBy("memo_key").agg(F.min(F.struct("_o", "answer")).alias("a")).select("memo_key", "a.answer")
