import datetime

from pyspark.sql import functions as F

from corvella.operators import extraction, sampling


def test_headings_are_monotone(spark):
    rows = [(1, 1, [2, 5]), (1, 2, [1, 4]), (1, 3, [3]), (1, 4, [9, 6]), (2, 1, [])]
    got = extraction.heading_pages(spark.createDataFrame(rows, "doc_id long, clause int, candidates array<int>")).collect()
    assert {(r.doc_id, r.clause): r.page for r in got} == {(1, 1): 2, (1, 2): 4, (1, 3): None, (1, 4): 6, (2, 1): None}


def test_anchor_acceptance_is_greedy(spark):
    texts = ["too short", "what is the leave quota today", "what is the leave quota today please", "who signs the transfer form", "where is the mess hall"]
    proposed = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, pos int, question string")
    existing = spark.createDataFrame([(1, "who signs the transfer form now")], "doc_id long, question string")
    assert sorted(r.pos for r in extraction.accepted_anchors(proposed, existing).collect()) == [1, 4]
    assert [r.pos for r in extraction.accepted_anchors(proposed, existing.limit(0), most=1).collect()] == [1]


def test_citations_and_lists(spark):
    def one(column, text):
        return spark.createDataFrame([(text,)], "t string").select(column).first()[0]

    assert one(extraction.cited(F.col("t")), "see clause 4, clauses 7-9 and clauses 1, 2,3") == ["1", "2", "3", "4", "7", "9"]
    assert one(extraction.list_from_text(F.col("t")), '["a", "b c"]') == ["a", "b c"]
    assert one(extraction.list_from_text(F.col("t")), "['a', 'b, c']") == ["a", "b, c"]
    assert one(extraction.settled_part(F.col("t")), "one\ntwo\nthr") == "one\ntwo\n"
    assert one(extraction.settled_part(F.col("t")), "none") == ""


def test_latest_date_prefers_clean_days(spark):
    d = datetime.date
    rows = [("a", d(2020, 1, 1), True, False), ("a", d(2021, 1, 1), False, False), ("a", d(2021, 1, 1), True, False), ("a", d(2022, 1, 1), True, True), ("b", d(2019, 5, 1), False, True)]
    got = extraction.latest_date(spark.createDataFrame(rows, "doc_id string, date date, day_known boolean, garbage boolean")).collect()
    assert {(r.doc_id, r.date, r.precision) for r in got} == {("a", d(2021, 1, 1), "day"), ("b", d(2019, 5, 1), "month")}


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = [r.k for r in sampling.sample(df, "k", 20).collect()]
    assert a == [r.k for r in sampling.sample(df.repartition(7), "k", 20).collect()] and len(set(a)) == 20
