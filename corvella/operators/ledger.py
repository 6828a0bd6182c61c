"""A spending ceiling over reservations, settlements and releases, folded in blocks.

Whether a reservation fits depends on all that came before it on its day. A day
is cut into blocks by order. Each block is folded from a guess of what is
committed at its start; what a block changes, or where it ends if it had to
refuse something, gives better guesses for those behind it. Only blocks whose
guess was wrong are folded again, until none is. The first wrong block of a day
is right after the next round, so the rounds end, and far from the ceiling, or
close to it throughout, two or three will do. No task reads more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored

BLOCK_ROWS = 100_000
ROW = "day date, block int, ts {ts}, seq long, id {id}, kind string, amount long, accepted boolean, delta long, refused boolean"


def _live(events: DataFrame) -> DataFrame:
    """The first reservation of each id of a day and the first settlement or release after it, with the reservation's amount (est)."""
    place = F.struct("ts", "seq")
    first = events.where("kind = 'reserve'").groupBy("day", "id").agg(F.min(F.struct("ts", "seq", "amount")).alias("r")).select(F.col("day").alias("_d"), F.col("id").alias("_i"), "r")
    same = (F.col("day") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_i"))
    known = events.join(first, same)
    reserved = known.where((F.col("kind") == "reserve") & (place == F.struct("r.ts", "r.seq")))
    closing = known.where(F.col("kind").isin("settle", "release") & (place > F.struct("r.ts", "r.seq")))
    closes = closing.groupBy("day", "id").agg(F.min(F.struct("ts", "seq", "kind", "amount", F.col("r.amount").alias("est"))).alias("c"))
    return reserved.select("day", "id", "ts", "seq", "kind", "amount", F.col("amount").alias("est")).unionByName(closes.select("day", "id", "c.*"))


def _fold(start: int, rows: list[tuple], ceiling: int) -> tuple[list[bool], int, bool]:
    """Verdicts, what is committed at the end, and whether something was refused. rows: kind, id, amount, est, told (of a closing whose reservation lies in another block: its verdict)."""
    committed, taken, verdicts, refused = start, {}, [], False
    for kind, name, amount, est, told in rows:
        if kind == "reserve":
            ok = est is not None and committed + est <= ceiling
            committed += est if ok else 0
            refused |= not ok
            taken[name] = ok
        else:
            ok = bool(taken.get(name, told))
            committed += ((amount or 0) if kind == "settle" else 0) - est if ok else 0
        verdicts.append(ok)
    return verdicts, committed, refused


def _folded(rows: DataFrame, starts: dict, ceiling: int, schema: str) -> DataFrame:
    """One row of ROW for each row and one, without id and kind, for each block. rows: sorted by day, block, ts, seq."""
    sent = rows.sparkSession.sparkContext.broadcast(starts)  # a number a block and day
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(t: pa.Table) -> pa.RecordBatch:
            day, block = t.column("day")[0].as_py(), t.column("block")[0].as_py()
            start = sent.value.get((day, block), 0)
            verdicts, end, refused = _fold(start, list(zip(*(t.column(c).to_pylist() for c in ("kind", "id", "amount", "est", "told")))), ceiling)
            n = t.num_rows
            columns = {c: t.column(c).combine_chunks() for c in ("day", "block", "ts", "seq", "id", "kind", "amount")}
            columns = {c: pa.concat_arrays([v, pa.array([day if c == "day" else block if c == "block" else None], v.type)]) for c, v in columns.items()}
            columns |= {"accepted": pa.array([*verdicts, None], pa.bool_()), "delta": pa.array([None] * n + [end - start], pa.int64()), "refused": pa.array([None] * n + [refused], pa.bool_())}
            return pa.record_batch([columns[c] for c in names], names=names)

        held, last = [], None
        for batch in batches:
            keys = list(zip(batch.column("day").to_pylist(), batch.column("block").to_pylist()))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if held and keys[a] != last:
                        yield out(pa.Table.from_batches(held))
                        held = []
                    held.append(batch.slice(a, b - a))
                    last = keys[a]
        if held:
            yield out(pa.Table.from_batches(held))

    return rows.mapInArrow(run, schema)


def enforced(events: DataFrame, ceiling: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """day, ts, seq, id, kind, amount, accepted of every event, in the order of (ts, seq) within its day.

    events: day, ts, seq, id, kind (reserve, settle, release), amount (whole
    cents). A reservation is accepted if what is spent and reserved so far and
    its amount stay within the ceiling. A settlement puts its own amount in
    place of the reservation's, a release gives that back; both are accepted if
    they are the first to close an accepted reservation. A second reservation
    of an id and a null amount are refused.
    """
    events = events.select("day", "ts", "seq", "id", "kind", F.col("amount").cast("long").alias("amount"))
    kind = dict(events.dtypes)
    schema = ROW.format(ts=kind["ts"], id=kind["id"])
    blocks = max(1, -(-events.count() // block_rows))
    cut = _live(events).repartitionByRange(blocks, "day", "ts", "seq").withColumn("block", F.spark_partition_id())
    cut = stored(cut)
    home = cut.where("kind = 'reserve'").select(F.col("day").alias("_d"), F.col("id").alias("_i"), F.col("block").alias("home"))
    # Closings whose reservation lies in another block need its verdict.
    rows = stored(cut.join(home, (F.col("day") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_i")), "left").drop("_d", "_i"))
    away = rows.where("kind <> 'reserve' AND home <> block").select("day", "id", "block")
    names = sorted((r.day, r.block) for r in rows.select("day", "block").distinct().collect())
    starts, ends, todo, known = {}, {}, set(names), None
    while todo:
        again = rows
        if known is not None:
            chosen = events.sparkSession.createDataFrame(sorted(todo), "day date, block int")
            again = rows.join(F.broadcast(chosen), ["day", "block"], "left_semi")
            verdicts = known.where("kind = 'reserve'").select(F.col("day").alias("_d"), F.col("id").alias("_i"), F.col("accepted").alias("told"))
            outside = F.col("home") != F.col("block")
            met = again.where(outside).join(verdicts, (F.col("day") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_i")), "left").drop("_d", "_i")
            again = met.unionByName(again.where(~outside).withColumn("told", F.lit(None).cast("boolean")))
        else:
            again = again.withColumn("told", F.col("est") <= ceiling)
        again = again.repartition("day", "block").sortWithinPartitions("day", "block", "ts", "seq")
        new = _folded(again.select("day", "block", "ts", "seq", "id", "kind", "amount", "est", "told"), dict(starts), ceiling, schema)
        if known is not None:
            new = new.unionByName(known.join(F.broadcast(chosen), ["day", "block"], "left_anti").select(*new.columns))
        new = stored(new)
        ends = {(r.day, r.block): (r.delta, r.refused) for r in new.where("kind IS NULL").collect()}
        better, day, at = {}, None, 0
        for d, b in names:
            if d != day:
                day, at = d, 0
            better[d, b] = at
            delta, refused = ends[d, b]
            # A block that refused something ends near the ceiling from wherever it started.
            at = starts.get((d, b), 0) + delta if refused else at + delta
        todo = {k for k in names if better[k] != starts.get(k, 0)}
        if known is not None or away.limit(1).count():
            old = (known if known is not None else rows.withColumn("accepted", F.col("est") <= ceiling)).where("kind = 'reserve'").select(F.col("day").alias("_d"), F.col("id").alias("_i"), F.col("accepted").alias("was"))
            turned = new.where("kind = 'reserve'").join(old, (F.col("day") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_i"))).where("accepted <> was").select("day", "id")
            todo |= {(r.day, r.block) for r in away.join(turned, ["day", "id"]).select("day", "block").distinct().collect()}
        starts, known = better, new
    if known is None:
        return events.withColumn("accepted", F.lit(False))
    verdicts = known.where("kind IS NOT NULL").select(F.col("day").alias("_d"), F.col("ts").alias("_t"), F.col("seq").alias("_s"), F.col("kind").alias("_k"), "accepted")
    joined = events.join(verdicts, (F.col("day") == F.col("_d")) & (F.col("ts") == F.col("_t")) & (F.col("seq") == F.col("_s")) & (F.col("kind") == F.col("_k")), "left")
    return joined.select("day", "ts", "seq", "id", "kind", "amount", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def day_totals(judged: DataFrame, ceiling: int) -> DataFrame:
    """day, spent, reserved, room, refused of events with their verdicts (see enforced): settled amounts, amounts still reserved, what is left, reservations turned down."""
    closed = judged.where("accepted AND kind <> 'reserve'").select(F.col("day").alias("_d"), F.col("id").alias("_i"), F.lit(True).alias("closed"))
    rows = judged.join(closed, (F.col("day") == F.col("_d")) & F.col("id").eqNullSafe(F.col("_i")), "left")

    def total(of: Column) -> Column:
        return F.coalesce(F.sum(F.when(of, F.col("amount"))), F.lit(0))

    reserve = F.col("kind") == "reserve"
    sums = rows.groupBy("day").agg(
        total(F.col("accepted") & (F.col("kind") == "settle")).alias("spent"), total(F.col("accepted") & reserve & F.col("closed").isNull()).alias("reserved"), F.sum((reserve & ~F.col("accepted")).cast("long")).alias("refused")
    )
    return sums.select("day", "spent", "reserved", F.greatest(F.lit(ceiling) - F.col("spent") - F.col("reserved"), F.lit(0)).alias("room"), "refused")
