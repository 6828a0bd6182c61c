"""Operators of documents, answers, curation, harvest, intake and experiments: unit cases."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators import answers, chunking, curation, embedding, experiments, harvest, intake, logs, stored
from corvella.sources import files


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame([values], ", ".join(f"{n} string" for n in names)).select(column(*[F.col(n) for n in names]).alias("x")).first().x


def test_values_at_narrows_a_range(spark):
    rng = random.Random(4)
    values = [rng.randint(0, 5000) for _ in range(9000)] + [7] * 2000
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int").repartition(5)
    want = sorted(values)
    for most in (10, 1_000_000):
        got = {r.place: r.value for r in stored.values_at(df, "v", lambda n: [0, n // 3, n - 1], most=most).collect()}
        assert got == {i: want[i] for i in (0, len(want) // 3, len(want) - 1)}
    assert stored.values_at(df.limit(0), "v", lambda n: [0]).count() == 0
    got = {r.share: r.value for r in stored.quantiles(df, "v", [0.25, 0.5]).collect()}
    at = (len(want) - 1) * 0.25
    assert got[0.25] == pytest.approx(want[int(at)] + (want[int(at) + 1] - want[int(at)]) * (at - int(at)))


def test_two_quotas_against_loop(spark):
    rng = random.Random(6)
    day = datetime.datetime(2024, 1, 1)
    rows = sorted((day + datetime.timedelta(seconds=rng.randrange(3 * 86_400)), i, rng.randrange(6)) for i in range(600))
    got = {r.seq: r.verdict for r in logs.two_quotas(spark.createDataFrame(rows, "ts timestamp, seq long, user long"), 9, 40).collect()}
    total, mine, want = {}, {}, {}
    for ts, seq, user in rows:
        d = ts.date()
        if total.get(d, 0) >= 40:
            want[seq] = "global"
        elif mine.get((d, user), 0) >= 9:
            want[seq] = "user"
        else:
            want[seq], total[d], mine[d, user] = "ok", total.get(d, 0) + 1, mine.get((d, user), 0) + 1
    assert got == want


def test_is_numbered_needs_a_dense_run(spark):
    def numbered(markers):
        return spark.createDataFrame([(markers,)], "m array<int>").select(curation.is_numbered(F.col("m"))).first()[0]

    rng = random.Random(2)
    for _ in range(40):
        m = sorted(rng.sample(range(1, 130), rng.randint(0, 25)))
        want = max(sum(x in m for x in range(s, s + 12)) for s in range(1, 90)) >= 6
        assert bool(numbered(m)) == want, m


def test_citations(spark):
    text = "ראו סעיף 4, סעיפים 7-9 וסעיפים 1, 2, ו-12"
    assert one(spark, curation.cited_clauses, text) == [1, 2, 4, 7, 9, 12]
    assert one(spark, curation.clause_markers, "43 . חשוד 5. x 1234. y 43. z") == [5, 43]


def test_typos_change_one_place(spark):
    for kind in experiments.TYPOS:
        got = spark.createDataFrame([("abcde", 2)], "w string, at int").select(experiments.typo(F.col("w"), F.lit(kind), F.col("at"), "z")).first()[0]
        assert got == {"swap": "acbde", "double": "abbcde", "drop": "acde", "near": "azcde"}[kind]
    assert spark.createDataFrame([("ab", 1)], "w string, at int").select(experiments.typo(F.col("w"), F.lit("drop"), F.col("at"))).first()[0] == "ab"


def test_degraded_kinds(spark):
    rows = [(i, f"what is, the leave 1{i} of a soldier?") for i in range(200)]
    got = experiments.degraded(spark.createDataFrame(rows, "id long, text string"), {"leave": "break"}, "xyz").collect()
    assert {r.kind for r in got} == set(experiments.KINDS)
    plain = dict(rows)
    for r in got:
        words = plain[r.id].split()
        assert {
            "typo": len(r.text.split()) == len(words) and 0 <= sum(a != b for a, b in zip(words, r.text.split())) <= 2,
            "fragment": words[: len(r.text.split())] == r.text.split() and len(words) - len(r.text.split()) in (2, 3),
            "slang": r.text == plain[r.id].replace("leave", "break", 1),
            "ocr": r.text == plain[r.id].translate(str.maketrans("710938", "170693")),
            "no-marks": r.text == plain[r.id].replace("?", "").replace(",", ""),
        }[r.kind], r


def test_garbled_windows(spark):
    today = F.lit(datetime.date(2026, 8, 1))
    for text, want in (("in 4711", True), ("in 2011", False), ("in 6002", False), ("1.22", True), (".532", True), ("53.0", True), ("8.0109", False), ("3.4.2019", False)):
        assert one(spark, lambda c: harvest.garbled(c, today), text) == want, text


def test_embedder_is_called_for_misses_only(spark, tmp_path):
    texts = spark.createDataFrame([("a b",), ("c",), ("a b",), (None,)], "text string")
    none = spark.createDataFrame([], "text_sha1 string, model string, vector array<double>")
    every, new = embedding.embedded(texts, none, embedding.hashed_words(8), "m")
    assert every.count() == new.count() == 2
    embedding.append_cache(new, str(tmp_path / "cache"))
    cache = spark.read.parquet(str(tmp_path / "cache"))
    again, newer = embedding.embedded(texts, cache, embedding.hashed_words(8), "m")
    assert again.count() == 2 and newer.count() == 0
    assert all(abs(sum(x * x for x in r.vector) - 1) < 1e-9 for r in again.collect())


def test_header_repair(spark):
    rows = spark.createDataFrame([("1", "2")], "b string, c string")
    out, header = intake.with_columns_of(rows, ["a", "b"])
    assert header == out.columns == ["a", "b", "c"] and tuple(out.first()) == (None, "1", "2")


def test_clause_reference_and_lines(spark):
    assert tuple(one(spark, intake.clause_reference, "clause 12(b)")) == (12, "b")
    assert tuple(one(spark, intake.clause_reference, "4.2")) == (4, "2")
    assert one(spark, intake.clause_reference, "none") is None
    pages = spark.createDataFrame([(1, 1, "a\n\n .3\n4\n.\nx")], "doc_id long, page int, text string")
    lines = intake.page_lines(pages)
    assert [(r.pos, r.line) for r in lines.orderBy("pos").collect()] == [(0, "a"), (2, ".3"), (3, "4"), (4, "."), (5, "x")]
    assert {(r.clause, r.pos) for r in intake.heading_numbers(lines).collect()} == {(3, 2), (4, 3)}


def test_files_that_are_not_there_and_staging(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text('{"d1": {"s:1": 4}, "d2": {}}')
    assert [tuple(r) for r in files.read_map(spark, str(path), "int").collect()] == [("d1", "s:1", 4)]
    assert files.read_map(spark, str(tmp_path / "none.json"), "int").count() == 0
    rows = spark.createDataFrame([("a", "x" * 700), ("b", "short"), ("c", "y" * 700)], "name string, raw_text string")
    catalogue = spark.createDataFrame([("a", "A"), ("b", "B")], "name string, title string")
    assert [r.name for r in files.staged(rows, catalogue).collect()] == ["a"]
    pages = spark.createDataFrame([(1, "x" * 1000), (1, "x" * 700), (2, "x" * 1000)], "doc_id long, text string")
    assert [r.doc_id for r in files.dense_text(pages).collect()] == [2]
    docs = spark.createDataFrame([("d", "A title: of it")], "document_id string, title string")
    files.write_documents(docs, str(tmp_path / "docs"))
    assert spark.read.parquet(str(tmp_path / "docs")).first().slug == "A-title--of-it"


def test_short_key_and_groups(spark):
    assert len(one(spark, lambda a, b: T.short_key(a, b), "x", "y")) == 16
    got = spark.createDataFrame([("one two",)], "t string").select(T.all_groups(F.col("t"), F.array(F.array(F.lit("one")), F.array(F.lit("no"), F.lit("two"))))).first()[0]
    assert got is True


def test_upsert_keeps_the_newest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "id string, v int, t string")
    assert {(r.id, r.t) for r in chunking.latest(df, ["id"], ["v"]).collect()} == {("a", "y"), ("b", "z")}


def test_context_of_nothing(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None)], "query_id long, rank int, doc_id long, title string, clause string, text string")
    assert answers.context_of(df, "nothing").first().context == "nothing"


def test_passages_stitch_and_merge(spark):
    from corvella.plans.retrieve import merged_rows, passages

    words = [f"w{i}" for i in range(400)]
    chunks = [(1, 1, "chunk", 0, "T\n" + " ".join(words[:180])), (2, 1, "chunk", 1, "T\n" + " ".join(words[140:320])), (3, 2, "key-facts", 0, "T\nlead body"), (4, 2, "key-facts", 1, "T\nmore of it"), (5, 2, "key-facts", 2, "T\n" + "long " * 50)]
    table = spark.createDataFrame(chunks, "row_id long, doc_id long, section string, pos long, text string")
    folded = spark.createDataFrame([(9, 3, 2, "key-facts", 0, 0.9, True), (9, 4, 2, "key-facts", 1, 0.5, False), (9, 5, 2, "key-facts", 2, 0.4, False)], "query_id long, row_id long, doc_id long, section string, pos long, score double, lifted boolean")
    merged = merged_rows(folded, table, 10)
    assert [(r.lead_id, r.row_id, r.total_words) for r in merged.collect()] == [(3, 4, 6)]
    found = spark.createDataFrame([(9, 1, 1, "chunk", 0, 0.7), (9, 2, 1, "chunk", 1, 0.6), (9, 3, 2, "key-facts", 0, 0.9)], "query_id long, row_id long, doc_id long, section string, pos long, score double")
    got = {r.section: (r.first_pos, r.last_pos, r.text) for r in passages(found, table, merged).collect()}
    assert got == {"chunk": (0, 1, " ".join(words[:320])), "key-facts": (0, 0, "T\nlead body\nmore of it")}
