"""Tables in files that take repeated batches: upserts by bucket, two sinks a batch, ingest with quarantine, versions.

Every write names the partitions it owns (buckets, a batch id, a version) and
overwrites just those, so a batch that comes again leaves the table as it was.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvella.operators.intake import with_columns_of
from corvella.operators.stored import stored

from .files import exists

BUCKETS = 64


def _replace(rows: DataFrame, path: str, by: list[str], kind: str = "parquet") -> None:
    """Writes rows, overwriting the partitions that they have and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(kind).save(path)


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def upsert(rows: DataFrame, path: str, key: str, version: str, buckets: int = BUCKETS) -> None:
    """Puts rows into a table hashed by key, of each key the row of the highest version (ties: the greater hash of its columns).

    Only buckets that the rows fall into are read and rewritten; files of the
    others stay as they are. buckets must not change over a table's life.
    Columns that only one side has are null on the other. Null keys are a key
    like any other.
    """
    spark = rows.sparkSession
    new = stored(rows.withColumn("bucket", bucket_of(key, buckets)))
    touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # buckets at most
    if not touched:
        return
    every = new
    if exists(spark, path):
        old = spark.read.option("mergeSchema", True).parquet(path).where(F.col("bucket").isin(touched))
        every = old.unionByName(new, allowMissingColumns=True)
    kept = [c for c in every.columns if c != "bucket"]
    rank = F.struct(F.col(version), F.xxhash64(*[F.to_json(F.struct(*kept))]))
    latest = every.groupBy("bucket", F.col(key).alias("_key")).agg(F.max_by(F.struct(*kept), rank).alias("row"))
    latest = stored(latest.select("row.*", "bucket"))  # the table is read before it is written
    _replace(latest.repartition("bucket").sortWithinPartitions("bucket", key), path, ["bucket"])


def read_keys(spark: SparkSession, path: str, key: str, keys: list, buckets: int = BUCKETS) -> DataFrame:
    """Rows of a few keys: only their buckets are read."""
    wanted = spark.createDataFrame([(k,) for k in keys], f"_k {spark.read.parquet(path).schema[key].dataType.simpleString()}").select(bucket_of("_k", buckets).alias("b"))
    return spark.read.parquet(path).where(F.col("bucket").isin([r.b for r in wanted.distinct().collect()]) & F.col(key).isin(keys)).drop("bucket")


def write_both(batch: DataFrame, batch_id: int, log: str, table: str) -> None:
    """One batch of a log (with a column tab) into two sinks: JSON lines as they come, and a table with one header.

    The table's header is what it stores already, and columns that it lacks go
    to its right; rows that lack columns of it have nulls there. Both sinks are
    partitioned by tab and batch, so that a batch id that comes again replaces
    itself.
    """
    spark = batch.sparkSession
    rows = stored(batch.withColumn("batch", F.lit(batch_id).cast("long")))
    if not rows.limit(1).count():
        return
    _replace(rows, log, ["tab", "batch"], "json")
    header = [c for c in spark.read.option("mergeSchema", True).parquet(table).columns if c not in ("tab", "batch")] if exists(spark, table) else []
    told, _ = with_columns_of(rows, [*header, *[c for c in ("tab", "batch") if header]])
    _replace(told, table, ["tab", "batch"])


def dual_sink(events: DataFrame, log: str, table: str, checkpoint: str) -> None:
    """Runs a stream of log rows into both sinks until it is at its end."""
    query = events.writeStream.foreachBatch(lambda batch, n: write_both(batch, n, log, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query.start().awaitTermination()


def read_tab(spark: SparkSession, table: str, tab: str) -> DataFrame:
    """Rows of one tab; the other tabs' partitions are not read. Older files have nulls in newer columns."""
    return spark.read.option("mergeSchema", True).parquet(table).where(F.col("tab") == tab)


def ingest_documents(spark: SparkSession, source: str, schema: str, key: str, target: str, quarantine: str, checkpoint: str) -> None:
    """New JSON files of a folder, one document each, into a table; those that can't be read into another, with their path and the reason.

    A file is looked at once. Reasons: empty, not json (or of other types than
    the schema's), no <key>. Both tables are partitioned by batch.
    """
    shape = T.StructType.fromDDL(f"{schema}, _broken string")
    files = spark.readStream.text(source, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}

    def put(batch: DataFrame, batch_id: int) -> None:
        told = batch.withColumn("doc", F.from_json("value", shape, options)).withColumn("batch", F.lit(batch_id).cast("long"))
        reason = F.when(F.trim("value") == "", "empty").when(F.col("doc").isNull() | F.col("doc._broken").isNotNull(), "not json").when(F.col(f"doc.{key}").isNull(), f"no {key}")
        told = stored(told.withColumn("reason", reason))
        good = told.where("reason IS NULL").select(*[F.col(f"doc.{c}").alias(c) for c in shape.fieldNames()[:-1]], "path", "batch")
        _replace(good, target, ["batch"])
        _replace(told.where("reason IS NOT NULL").select("path", "reason", "batch"), quarantine, ["batch"])

    files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def accept(snapshot: DataFrame, path: str, version: int, healthy: str) -> None:
    """Adds the healthy rows of a snapshot as a version of a baseline; the version that comes again replaces itself."""
    _replace(snapshot.where(healthy).withColumn("version", F.lit(version).cast("long")), path, ["version"])


def read_versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)
