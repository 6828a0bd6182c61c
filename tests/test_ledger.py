"""The spending ceiling in blocks against a loop."""

import datetime
import random

import pytest

from corvella.operators import ledger

DAYS = [datetime.date(2024, 5, d) for d in (1, 2, 3)]


def slow(events, ceiling):
    out, state = {}, {}
    for day, ts, seq, name, kind, amount in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        committed, entries = state.setdefault(day, [0, {}])
        ok = False
        if kind == "reserve":
            if name not in entries:
                ok = amount is not None and committed + amount <= ceiling
                entries[name] = [amount, "open" if ok else "refused"]
                state[day][0] += amount if ok else 0
        elif entries.get(name, (0, ""))[1] == "open":
            ok = True
            state[day][0] += (amount or 0) * (kind == "settle") - entries[name][0]
            entries[name][1] = kind
        elif name in entries and entries[name][1] == "refused":
            entries[name][1] = "void"
        out[day, seq] = ok
    return out


@pytest.mark.parametrize("ceiling,block_rows", [(2_000, 40), (300, 25), (100_000, 30), (0, 50), (1_500, 10**6)])
def test_ceiling_against_loop(spark, ceiling, block_rows):
    rng = random.Random(ceiling)
    events, seq = [], 0
    for day in DAYS:
        names = []
        for k in range(rng.choice([120, 200])):
            kind = rng.choice(["reserve", "reserve", "settle", "release"]) if names else "reserve"
            name = len(names) if kind == "reserve" and rng.random() < 0.95 else rng.choice(names or [0])
            if kind == "reserve":
                names.append(name)
            events.append((day, k // 3, seq, name, kind, rng.choice([None, *range(1, 120)])))
            seq += 1
    df = spark.createDataFrame(events, "day date, ts long, seq long, id long, kind string, amount long")
    judged = ledger.enforced(df, ceiling, block_rows).cache()
    want = slow(events, ceiling)
    assert {(r.day, r.seq): r.accepted for r in judged.collect()} == want
    for r in ledger.day_totals(judged, ceiling).collect():
        closed = {e[3]: e for e in events if e[0] == r.day and e[4] != "reserve" and want[r.day, e[2]]}
        spent = sum(e[5] or 0 for e in closed.values() if e[4] == "settle")
        reserved = sum(e[5] for e in events if e[0] == r.day and e[4] == "reserve" and want[r.day, e[2]] and e[3] not in closed)
        assert (r.spent, r.reserved, r.room) == (spent, reserved, max(0, ceiling - spent - reserved))


def test_ceiling_of_no_events(spark):
    none = spark.createDataFrame([], "day date, ts long, seq long, id long, kind string, amount long")
    assert ledger.enforced(none, 5).count() == 0
