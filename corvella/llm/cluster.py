"""Shared-folder and partitioning helpers for the training-data operators."""

from __future__ import annotations

import re
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared(df: DataFrame) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``. Only on one machine a
    temporary folder is chosen where that is unset; a cluster must name one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local($|\[)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


#: Rows and bytes that go to Python at a time. Texts are long, so both are below Spark's defaults.
ROWS_A_BATCH, BYTES_A_BATCH = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Session settings of the registered queries and of the pipeline; operators work with any."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_A_BATCH))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BYTES_A_BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def byte_length(text: Column) -> Column:
    return F.octet_length(F.coalesce(text, F.lit("")))


def row_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two 64-bit keys of a row's content; rows that share both are repeated rows."""
    return F.xxhash64(doc_id, text), F.xxhash64(F.lit(1), text, doc_id)


def text_chunks(batch: pa.RecordBatch, column: str, max_bytes: int = 1 << 20):
    """Slices of a batch with about max_bytes of text each; a longer text comes alone."""
    sizes = batch.column(column)
    lengths = [x or 0 for x in pc.binary_length(sizes).to_pylist()]
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start)


def runs_of(batches, key: str):
    """Consecutive rows with one key, joined over batch borders. The input is sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *((keys[1:] != keys[:-1]).nonzero()[0] + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and keys[a] != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = keys[a]
    if held:
        yield last, pa.Table.from_batches(held)
