"""Operators against slow Python versions and unit cases."""

import datetime
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from corvella.functions import amounts, dates, vectors
from corvella.functions import text as T
from corvella.operators import chunking, conversations, diff, dims, gates, index, logs, ranking
from corvella.plans.retrieve import retrieve
from corvella.sources import files
from corvella.streaming import quota

HITS = "query_id long, row_id long, doc_id long, section string, score double"


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_chunk_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(n))), "t") for n in (1,)] + [(2, " ".join(map(str, range(281))), "t"), (3, "  \n", "t"), (4, None, "t")], "doc_id long, text string, source string")
    got = {(r.doc_id, r.chunk_ord): r.body.split() for r in chunking.chunk_windows(docs).collect()}
    assert set(got) == {(1, 0), (2, 0), (2, 1), (2, 2)}
    assert len(got[2, 0]) == 180 and got[2, 1][0] == "140" and got[2, 2] == ["280"]


def test_anchor_rows_number_before_filter(spark):
    df = spark.createDataFrame([(1, ["short", "a long enough question", "a long enough question", "another long question"])], "doc_id long, questions array<string>")
    assert {(r.id, r.text) for r in chunking.anchor_rows(df).collect()} == {("1__sq1", "a long enough question"), ("1__sq2", "another long question")}


def test_term_variants(spark):
    rules = T.Rules("wb", ("x", "y"), ("s",), ("ed",))
    got = dict(zip(["(the)", "ab", "wbword", "cats", "walked", "endx"], values(spark, T.term_variants(F.col("w"), rules), [(w,) for w in ["(the)", "ab", "wbword", "cats", "walked", "endx"]], "w string")))
    assert got["(the)"] == ["the"] and got["ab"] == []
    assert got["wbword"] == ["wbword", "bword", "word", "ord"]
    assert got["cats"] == ["cats"] and got["endx"] == ["endy"]
    assert "walk" in got["walked"]
    assert values(spark, T.term_variants(F.col("w"), T.HEBREW), [("ספרים",)], "w string")[0] == ["ספרימ"]


def brute_depth(rows, n, cap, depth):
    rows = sorted(rows, key=lambda r: (-r[4], r[1]))
    seen, capped = {}, []
    for r in rows:
        seen[r[2]] = seen.get(r[2], 0) + 1
        if seen[r[2]] <= cap:
            capped.append(r)
    picked, rest = capped[:n], capped[n:]
    if picked and depth > 1:
        lead = picked[0][2]
        extra = [r for r in rest if r[2] == lead]
        while extra and sum(r[2] == lead for r in picked) < min(depth, cap):
            victims = [r for r in picked if r[2] != lead]
            if not victims:
                break
            picked.remove(victims[-1])
            picked.append(extra.pop(0))
    return [r[1] for r in sorted(picked, key=lambda r: (-r[4], r[1]))]


def test_winner_depth_against_loop(spark):
    rng = random.Random(1)
    rows = [(q, i, rng.randint(0, 4), "chunk", rng.randint(0, 12) / 10) for q in range(60) for i in range(rng.randint(1, 25))]
    df = spark.createDataFrame(rows, HITS)
    for n, cap, depth in ((8, 4, 4), (5, 3, 3), (6, 4, 1)):
        got = {}
        for r in ranking.winner_depth(df, n, cap, depth).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.row_id)
        for q in range(60):
            assert got[q] == brute_depth([r for r in rows if r[0] == q], n, cap, depth)


def test_fold_and_budget_against_loop(spark):
    rng = random.Random(2)
    rows = [(q, i, rng.randint(0, 3), rng.choice(["sq", "key-facts1", "chunk0", "s2"]), rng.randint(0, 12) / 10, rng.randint(1, 80)) for q in range(50) for i in range(rng.randint(1, 16))]
    df = spark.createDataFrame(rows, HITS + ", n_words int")
    folded = ranking.fold_anchors(df)
    got = {(r.query_id, r.row_id): (r.score, r.lifted) for r in folded.collect()}
    merged = {(r.query_id, r.row_id): (r.lead_id, r.total_words) for r in ranking.budget_merge(folded, 120).collect()}
    want, want_merged = {}, {}
    for q in range(50):
        mine = [r for r in rows if r[0] == q]
        real = {r[1]: list(r) + [False] for r in mine if r[3] != "sq"}
        for d in {r[2] for r in mine}:
            anchors = [r[4] for r in mine if r[2] == d and r[3] == "sq"]
            own = sorted((r for r in real.values() if r[2] == d), key=lambda r: (-r[4], r[1]))
            if anchors and own and max(anchors) > own[0][4]:
                facts = [r for r in own if r[3].startswith("key-facts")]
                target = (facts or own)[0]
                target[4], target[6] = max(anchors), True
        want |= {(q, i): (r[4], r[6]) for i, r in real.items()}
        if real:
            winner = min(real.values(), key=lambda r: (-r[4], r[1]))
            lead = [r for r in real.values() if r[2] == winner[2] and r[6]]
            if lead:
                total = lead[0][5]
                for r in sorted((r for r in real.values() if r[2] == winner[2] and not r[6] and r[3].startswith("key-facts")), key=lambda r: (-r[4], r[1])):
                    total += r[5]
                    if total > 120:
                        break
                    want_merged[q, r[1]] = (lead[0][1], total)
    assert got == want and merged == want_merged


def test_stitch_restores_passages(spark):
    words = [f"w{i}" for i in range(900)]
    docs = spark.createDataFrame([(1, " ".join(words), "t")], "doc_id long, text string, source string")
    rows = chunking.chunk_windows(docs).where("chunk_ord <> 3").select(F.lit(1).alias("query_id"), "doc_id", F.col("chunk_ord").alias("pos"), "body", F.lit(0.5).alias("score"))
    got = {(r.first_pos, r.last_pos): r.passage.split() for r in ranking.stitch(rows).collect()}
    assert got == {(0, 2): words[: 280 + 180], (4, 6): words[560:]}


def test_neighbours(spark):
    sel = spark.createDataFrame([(1, 5, 3, "chunk3", 0.9, 1), (1, 5, 5, "chunk5", 0.8, 2), (1, 6, 0, "chunk0", 0.7, 3)], "query_id long, doc_id long, pos long, section string, score double, rank int")
    windows = spark.createDataFrame([(5, p) for p in range(6)] + [(6, 1)], "doc_id long, pos long")
    assert {tuple(r) for r in ranking.neighbours(sel, windows).collect()} == {(1, 5, 2, 0.899), (1, 5, 4, 0.899)}


def test_reserved_merge(spark):
    main = spark.createDataFrame([(1, i, i + 1) for i in range(8)], "query_id long, row_id long, rank int")
    extra = spark.createDataFrame([(1, i, i - 4) for i in range(5, 12)], "query_id long, row_id long, rank int")
    got = [r.row_id for r in ranking.reserved_merge(main, extra).orderBy("place").collect()]
    assert got == [0, 1, 2, 3, 4, 5, 8, 9]


def test_quotas_against_fold(spark):
    rng = random.Random(3)
    rows = [(f"2024-01-0{rng.randint(1, 2)} 10:00:{rng.randint(10, 59)}", i, f"u{rng.randint(0, 6)}") for i in range(200)]
    df = spark.createDataFrame(rows, "ts string, seq long, user string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.seq: r.verdict for r in logs.two_quotas(df, 5, 20).collect()}
    want, day, total, users = {}, None, 0, {}
    for ts, seq, user in sorted(rows):
        if ts[:10] != day:
            day, total, users = ts[:10], 0, {}
        if total >= 20:
            want[seq] = "global"
        elif users.get(user, 0) >= 5:
            want[seq] = "user"
        else:
            want[seq], total, users[user] = "ok", total + 1, users.get(user, 0) + 1
    assert got == want


def test_quota_stream_matches_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", quota.ROCKSDB)
    rng = random.Random(4)
    rows = [("2024-01-01 10:00:00", i, f"u{rng.randint(0, 3)}", False) for i in range(40)]
    for part, some in enumerate((rows[:25], rows[25:])):
        spark.createDataFrame(some, "ts string, seq long, user string, refund boolean").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, seq long, user string, refund boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = quota.quota_stream(stream, 5, 12).writeStream.format("memory").queryName("verdicts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.table("verdicts").collect()
    assert len(got) == 40
    assert sum(r.verdict == "ok" for r in got) == 12


def test_ingest_new_skips_known(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in (1, 2):
        (tmp_path / "in" / f"{n}.json").write_text(json.dumps({"id": n}))
        quota.ingest_new(spark, str(tmp_path / "in"), "id long", str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_history_trim(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", str(t)) for t in range(15)] + [(2, 0, "assistant", "x"), (2, 1, "user", "y")]
    got = {}
    for r in conversations.trimmed(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        got.setdefault(r.conv_id, []).append(r.turn)
    assert sorted(got[1]) == list(range(6, 15)) and got[2] == [1]


def test_dates(spark):
    d = datetime.date
    rows = [(d(2024, 1, 31), d(2024, 2, 29)), (d(2024, 1, 15), d(2024, 3, 15)), (d(2024, 3, 1), d(2024, 1, 1)), (None, d(2024, 1, 1))]
    assert values(spark, dates.months_between(F.col("a"), F.col("b")), rows, "a date, b date") == [0, 2, None, None]
    assert values(spark, dates.dotted_date(F.col("t")), [("on 5.3.26",), ("31.12.27",), ("1.2.1999",), ("none",)], "t string") == ["2026-03-05", "1927-12-31", "1999-02-01", None]
    assert values(spark, dates.built_date(F.col("y"), F.col("m"), F.col("d"), F.lit("2025-01-01").cast("date")), [(2024, 2, 30), (2024, 2, None), (2026, 1, 1)], "y int, m int, d int") == [None, d(2024, 2, 1), None]


def test_amounts(spark):
    assert values(spark, amounts.daily_pay(F.col("s"), 100.0, 1000.0), [(0.0,), (-5.0,), (12000.0,), (1000.0,), (99000.0,)], "s double") == [None, None, 400.0, 100.0, 1000.0]
    assert values(spark, amounts.estimate(F.col("r"), F.col("m")), [(10.0, 29), (None, 3), (10.0, None), (2.5, 1)], "r double, m int") == [290.0, None, None, 2.0]
    low, high = amounts.wilson(F.col("k"), F.col("n"))
    got = spark.createDataFrame([(10, 100), (0, 0), (5, 5)], "k long, n long").select(low, high).collect()
    assert [round(x, 4) for x in got[0]] == [0.0552, 0.1744] and tuple(got[1]) == (0.0, 0.0) and got[2][1] == 1.0
    df, n = 3, 100
    want = round(min(math.log(1 + n / (1 + df)) / math.log(21), 1.5) / 0.25) * 0.25
    assert values(spark, amounts.term_weight(F.col("d"), F.col("n")), [(df, n)], "d long, n long") == [want]


def test_vectors(spark):
    assert values(spark, vectors.dot(F.col("v"), F.col("v")), [([3.0, 4.0],)], "v array<float>") == [25.0]
    assert values(spark, vectors.unit(F.col("v")), [([3.0, 4.0],), ([0.0, 0.0],)], "v array<float>") == [[0.6, 0.8], [0.0, 0.0]]


def test_text_gates(spark):
    assert values(spark, T.private(F.col("t")), [("call 050-123 45",), ("ok 12 34",), ("x" * 101,)], "t string") == [True, False, True]
    assert values(spark, T.refused(F.col("t"), ["not found"]), [("Sorry, not found",), ("x" * 90 + "not found",), ("fine",)], "t string") == [True, False, False]
    a = spark.createDataFrame([("a", "red green blue"), ("b", "cat dog")], "id string, text string")
    held = spark.createDataFrame([("h", "Red, green! blue gray"), ("k", "x")], "id string, text string")
    assert [tuple(r) for r in gates.mirrors(a, held, 0.55).collect()] == [("a", "h", 0.75)]
    assert values(spark, dims.tier_of(F.col("v"), [(0.0, "a"), (10.0, "b")]), [(-1.0,), (0.0,), (10.0,)], "v double") == [None, "a", "b"]


def test_verdict_classes(spark):
    cases = {"מותר": "yes", "אינך זכאי להחזר": "no", "אסור": "no", "לא אסור": "accent", "מותר בתנאים": "cond", "מותר אך ורק באישור": "cond", "אסור, אך מותר בבית": "cond", "לא נמצא במאגר": "none", "בנוגע למסדר": "accent", "מותר עד 7 ימים": "yes"}
    assert values(spark, T.verdict_class(F.col("t"), T.HEBREW_VERDICTS), [(c,) for c in cases], "t string") == list(cases.values())


def test_curation_gates(spark):
    assert set(values(spark, T.curation_stems(F.col("t")), [("המועברת אב",)], "t string")[0]) == {"המועברת", "מועברת"}
    assert "מועבר" in values(spark, T.curation_stems(F.col("t")), [("מועברה",)], "t string")[0]
    assert values(spark, T.json_debris(F.col("t")), [('clause text }]}}, 8]}], "',), ("a plain [note] here",), ('ends "}',)], "t string") == [True, False, True]
    assert values(spark, T.new_topic(F.col("a"), F.col("b"), [["risk", "danger"], ["leave"]]), [("a risk", "no"), ("a risk", "danger"), ("leave", "leave")], "a string, b string") == [True, False, False]


def test_diffs(spark):
    before = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id long, h string")
    after = spark.createDataFrame([(2, "z"), (3, None), (4, "w")], "id long, h string")
    assert {r.id: r.status for r in diff.snapshot_diff(before, after, "id", "h").collect()} == {1: "gone", 2: "changed", 3: "ok", 4: "new"}
    snap = after.withColumn("healthy", F.col("id") != 4)
    assert {tuple(r) for r in diff.rebased(before, snap, "id").collect()} == {(1, "x"), (2, "z"), (3, None)}


def test_popular_ties_go_to_the_latest(spark):
    log = spark.createDataFrame([("r", "first asked", 1), ("r", "second  asked", 2), ("r", "first asked", 3), ("r", "second asked", 4), ("r", "call 0501234567", 5)], "role string, question string, ts long")
    curated = spark.createDataFrame([("r", "second asked", 0), ("r", "curated one", 1)], "role string, question string, ord long")
    assert [r.question for r in logs.popular(log, curated).orderBy("place").collect()] == ["second asked", "first asked", "curated one"]


def test_documents_source(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"document_id": "a", "title": "A b!", "roles": [], "source_file": "a.pdf", "suggested_questions": ["one long question?"]}))
    (tmp_path / "b.json").write_text(json.dumps({"document_id": "b", "title": "B", "roles": ["reserve"], "source_file": "b.pdf", "suggested_questions": {"soldier": ["two long question?"]}}))
    (tmp_path / "c.json").write_text("{broken")
    docs = files.read_documents(spark, str(tmp_path))
    assert {r.document_id for r in docs.collect()} == {"a", "b"}
    assert {(r.doc_id, r.role, r.question) for r in files.questions(docs).collect()} == {("a", None, "one long question?"), ("b", "soldier", "two long question?")}
    assert {r.document_id for r in docs.where(files.in_scope(F.col("roles"), "soldier")).collect()} == {"a"}
    over = spark.createDataFrame([("b.pdf", ["soldier", "bogus"]), ("_note", ["soldier"]), ("a.pdf", ["bogus"])], "source_file string, roles array<string>")
    assert {r.document_id: r.roles for r in files.with_overrides(docs, over).collect()} == {"a": [], "b": ["soldier"]}
    assert files.read_jsonl(spark, str(tmp_path / "none"), "x long").count() == 0


def test_log_source(spark, tmp_path):
    rows = spark.createDataFrame([("questions", "q1"), ("feedback", "f1")], "tab string, question string")
    files.append_log(rows, str(tmp_path / "log"))
    files.append_log(rows, str(tmp_path / "log"))
    assert files.read_jsonl(spark, str(tmp_path / "log"), "tab string, question string").where("tab = 'questions'").count() == 2


def test_retrieve_scope_and_order(spark):
    rng = random.Random(6)
    chunks = [(i, i // 5, "sq" if i % 5 == 4 else f"chunk{i % 5}", i % 5, f"title\nword{i} common", [rng.random() for _ in range(4)]) for i in range(40)]
    df = spark.createDataFrame(chunks, "row_id long, doc_id long, section string, pos long, text string, embedding array<float>")
    queries = spark.createDataFrame([(1, "word7 common", [1.0, 0.0, 0.0, 0.0])], "query_id long, text string, embedding array<float>")
    got = retrieve(queries, df, n_results=5).orderBy("rank").collect()
    assert len(got) >= 5 and [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert all(r.section != "sq" for r in got)
    none = spark.createDataFrame([], "doc_id long")
    assert retrieve(queries, df, doc_ids=none).count() == 0
    only = spark.createDataFrame([(2,)], "doc_id long")
    assert {r.doc_id for r in retrieve(queries, df, doc_ids=only).collect()} == {2}


def test_unknown_terms_of_empty_vocabulary(spark):
    queries = spark.createDataFrame([(1, "anything here")], "query_id long, text string")
    chunks = spark.createDataFrame([], "chunk_id string, text string")
    assert [tuple(r) for r in index.unknown_terms(queries, chunks).collect()] == [(1, False)]


@pytest.mark.parametrize("ceiling,want", [(10.0, [True, False, True, False]), (0.0, [False] * 4)])
def test_spend_ceiling(spark, ceiling, want):
    rows = [(datetime.date(2024, 1, 1), i, i, v) for i, v in enumerate([6.0, 5.0, 4.0, 1.0])]
    got = logs.spend_ceiling(spark.createDataFrame(rows, "day date, ts long, id long, estimate double"), ceiling).orderBy("id").collect()
    assert [r.accepted for r in got] == want
