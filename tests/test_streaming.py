"""Streams against loops: quotas with day change, late rows and refunds; what is left of their state."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corvella.streaming import quota

EVENTS = "ts timestamp, seq long, user string, refund boolean"


@pytest.fixture()
def rocksdb(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, quota.ROCKSDB)
    yield spark
    spark.conf.set(name, old)


def slow_quota(batches, user_cap, global_cap):
    days, out = {}, []
    for batch in batches:
        for ts, seq, user, refund in sorted(batch):
            total, users = days.setdefault(ts.date(), [0, {}])
            mine = users.get(user or "", 0)
            if refund:
                verdict, total, mine = "refund", max(0, total - 1), max(0, mine - 1)
            elif total >= global_cap:
                verdict = "global"
            elif mine >= user_cap:
                verdict = "user"
            else:
                verdict, total, mine = "ok", total + 1, mine + 1
            users[user or ""] = mine
            days[ts.date()][0] = total
            out.append((ts.date(), seq, user or "", verdict))
    return sorted(out)


def test_quota_over_three_days(rocksdb, tmp_path):
    rng = random.Random(6)
    start, seq, batches = datetime.datetime(2024, 3, 1, 6), 0, []
    for k in range(6):  # twelve hours a batch; rows up to fifty minutes late
        batch = []
        for _ in range(60):
            at = start + datetime.timedelta(hours=12 * k, minutes=rng.randint(0, 710) - rng.choice([0, 0, 0, 50]))
            batch.append((at, seq, rng.choice(["a", "b", "c", "d", "e", "f", None]), rng.random() < 0.15))
            seq += 1
        batches.append(batch)
    for k, batch in enumerate(batches):
        rocksdb.createDataFrame(batch, EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = rocksdb.readStream.schema(EVENTS).parquet(str(tmp_path / "in"))
        written = quota.quota_stream(stream, 4, 22).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        written.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.day, r.seq, r.user, r.verdict) for r in rocksdb.read.parquet(str(tmp_path / "out")).collect())
    assert got == slow_quota(batches, 4, 22)
    assert {v for *_, v in got} == {"ok", "user", "global", "refund"} and len({d for d, *_ in got}) >= 3
    # Only the last day's state is left.
    left = rocksdb.read.format("statestore").option("stateVarName", "total").load(str(tmp_path / "cp"))
    days = {r.day for r in left.select(F.col("key.day").alias("day")).collect()}
    assert days == {max(d for d, *_ in got)}
    users = rocksdb.read.format("statestore").option("stateVarName", "users").load(str(tmp_path / "cp"))
    assert {r.day for r in users.select(F.col("key.day").alias("day")).collect()} <= days
