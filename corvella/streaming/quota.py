"""A daily quota as a stateful stream, and incremental ingest."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

VERDICTS = "day date, seq long, user string, verdict string"
#: State with several variables, timers and expiry needs this store; the session names it in spark.sql.streaming.stateStore.providerClass.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class DayQuota(StatefulProcessor):
    """A day's passes: their number, and that of each user with a pass. A timer ends the day once the watermark has passed it."""

    def __init__(self, user_cap: int, global_cap: int):
        self.user_cap, self.global_cap = user_cap, global_cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.total = handle.getValueState("total", "n long")
        self.users = handle.getMapState("users", "user string", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["ts", "seq"])
        if not self.total.exists():
            midnight = datetime.datetime.combine(key[0] + datetime.timedelta(days=1), datetime.time(), datetime.timezone.utc)
            self.handle.registerTimer(int(midnight.timestamp() * 1000))
        total = self.total.get()[0] if self.total.exists() else 0
        held: dict[str, int] = {}
        verdicts = []
        for user, refund in zip(batch["user"], batch["refund"]):
            if user not in held:
                held[user] = self.users.getValue((user,))[0] if self.users.containsKey((user,)) else 0
            if refund:
                verdict, total, held[user] = "refund", max(0, total - 1), max(0, held[user] - 1)
            elif total >= self.global_cap:
                verdict = "global"
            elif held[user] >= self.user_cap:
                verdict = "user"
            else:
                verdict, total, held[user] = "ok", total + 1, held[user] + 1
            verdicts.append(verdict)
        self.total.update((total,))
        for user, n in held.items():
            if n:
                self.users.updateValue((user,), (n,))
            elif self.users.containsKey((user,)):
                self.users.removeKey((user,))
        yield pd.DataFrame({"day": key[0], "seq": batch["seq"], "user": batch["user"], "verdict": verdicts})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.total.clear()
        self.users.clear()
        return iter(())

    def close(self) -> None:
        pass


def quota_stream(events: DataFrame, user_cap: int = 5, global_cap: int = 80, late: str = "1 hour") -> DataFrame:
    """Verdicts of a stream of events (ts, seq, user, refund): ok, user, global or refund.

    A day's state holds one number, and one for each user with a pass, so a row
    reads and writes its own user's only. Rows of a micro-batch count in the
    order of (ts, seq). A refund gives one pass back, not below zero. Rows may
    come `late`; after that the day's state is dropped, and rows that are later
    still are left out. Days are those of the session's time zone, which is to
    be UTC. A null user is the user "". State is as ROCKSDB keeps it.
    """
    keyed = events.select(F.col("ts").cast("timestamp").alias("ts"), "seq", F.coalesce("user", F.lit("")).alias("user"), "refund").withWatermark("ts", late)
    keyed = keyed.withColumn("day", F.to_date("ts"))
    return keyed.groupBy("day").transformWithStateInPandas(DayQuota(user_cap, global_cap), VERDICTS, "append", "eventTime")


def daily_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Extension: events per day and role by event time, with a watermark. ts may be a timestamp without zone."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("date").alias("day"), "event_type", "n")


def ingest_new(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> None:
    """Appends what is new in a folder of JSON files to a Parquet table, then stops; files seen before are skipped."""
    rows = spark.readStream.schema(schema).json(source)
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
