"""Work that must not grow faster than the tables: no repeated expressions, no shuffle by few keys, no rows that cannot count."""

import datetime
import re
import tracemalloc

import numpy as np
import pyarrow as pa
from corvella.functions import text as T
from corvella.operators import answers, curation, dense, experiments, gates, harvest, index, intake, scorer
from corvella.plans import registered
from oracle import agree
from pyspark.sql import functions as F


def test_the_patterns_of_a_date_stand_once_in_the_plan(spark):
    windows = spark.createDataFrame([("עודכן 1.2.2012", "m", True)], "text string, marker string, two_digit boolean")
    plan = harvest.candidates(windows, F.lit(datetime.date(2026, 8, 1)))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 6


def test_terms_of_rows_are_spread_in_bounded_memory():
    dice = np.random.default_rng(3)
    names = [f"t{i}" for i in range(500)]
    weights = dice.integers(0, 3, (500, 400))
    term, who = np.nonzero(weights)
    of = weights[term, who]
    starts = np.searchsorted(term, np.arange(501))
    block = scorer.Block(np.arange(400), np.zeros((400, 1)), names, starts, who, of, np.arange(400), np.ones(400, np.int64), {})
    held = [[names[i] for i in np.flatnonzero(x)] + ["unknown"] if x.any() else None for x in dice.random((2048, 500)) < 0.6]
    given = pa.array(held, pa.list_(pa.string()))
    want = np.array([sum((weights[int(t[1:])] for t in h or () if t != "unknown"), np.zeros(400, np.int64)) for h in held])
    tracemalloc.start()
    got = scorer._quarters(given, block)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all()
    assert peak < 200 << 20  # 600,000 terms x 256 queries x 4 bytes are 600 MB


def test_term_weights_do_not_join_words_with_chunks(spark, sf_dir, monkeypatch):
    def joined(*args, **kw):
        raise AssertionError("every word of every chunk is joined")

    monkeypatch.setattr(index, "term_chunks", joined)
    agree(spark, sf_dir, *registered()["term_weights"])


def test_stems_are_cut_from_documents_with_clauses_only(spark):
    clauses = spark.createDataFrame([(1, "1", "words")], "doc_id long, number string, text string")
    plan = curation.grounding(clauses, spark.range(9).selectExpr("id AS doc_id", "'some text' AS raw_text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan


def test_prices_do_not_shuffle_the_calls(spark):
    rows = spark.range(100).selectExpr("id", "if(id % 2 = 0, 'A', 'B') AS model", "id AS tokens_in", "id AS tokens_out", "id AS cache_write", "id AS cache_read", "true AS batch")
    prices = spark.createDataFrame([("A", 5.0, 25.0)], "model string, price_in double, price_out double")
    plan = experiments.call_cost(rows, prices, (5.0, 25.0))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_triage_scores_asked_queries_only(spark, sf_dir, monkeypatch):
    asked, scores = [], dense.pair_scores
    monkeypatch.setattr(dense, "pair_scores", lambda rows, queries, **kw: asked.append({r.query_id for r in queries.collect()}) or scores(rows, queries, **kw))
    agree(spark, sf_dir, *registered()["triage"])
    items = {r.item_id for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    assert len(asked) == 1 and asked[0] <= items


def test_white_space_is_stripped_as_patterns_do_without_a_pattern(spark):
    texts = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    sides = texts.select("c", F.concat("c", F.lit("a"), "c", F.lit("b"), "c").alias("t"))
    assert sides.where(~T.stripped(F.col("t")).eqNullSafe(F.regexp_replace("t", r"(?U)^\s+|\s+$", ""))).count() == 0
    assert sides.where(T.stripped(F.col("t")) != F.col("t")).count() == 25
    assert "regexp" not in texts.select(T.clean(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()


def test_the_patterns_of_a_source_stand_once_in_the_plan(spark):
    values = spark.createDataFrame([("a - b, סעיף 4; c",)], "v string")
    plan = values.select(answers.sources(F.col("v")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2 and plan.count("regexp_extract(") <= 1


def test_a_line_is_matched_once_for_each_part_of_its_label(spark):
    rows = spark.createDataFrame([(1, "**פסיקה:** a")], "id int, body string")
    plan = answers.blocks(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("{1,28}") <= 2


def test_files_are_dealt_out_by_order_once(spark, sf_dir):
    plan = registered()["file_changes"][0](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Join" not in plan


def test_files_without_key_or_path_and_repeated_ones(spark):
    base = spark.createDataFrame([(None, "a", "1"), ("o1", None, "1"), ("o2", "a", "1"), ("o2", "a", "2"), ("o2", "b", None), ("o3", "a", "1")], "k string, path string, digest string")
    now = spark.createDataFrame([(None, "b", "1", None), ("o2", "a", "2", None), ("o2", "b", None, ""), ("o3", "a", "2", "late"), ("o3", "a", "2", None), ("o4", "a", "1", None)], "k string, path string, digest string, error string")
    got = {r.k: (r.status, r.gone, r.added, r.failed, r.changed) for r in intake.file_status(base, now, "k").collect()}
    assert got == {None: ("ok", [], [], [], []), "o1": ("ok", [], [], [], []), "o2": ("changed", [], [], [], ["a"]), "o3": ("changed", [], [], ["a"], ["a"])}


def test_words_of_mirrors_are_not_shuffled(spark):
    texts = spark.createDataFrame([("a", "one two three")], "id string, text string").repartition("id")
    plan = gates.mirrors(texts, spark.createDataFrame([("h", "one two four")], "id string, text string"), 0.55)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id#" in plan and not re.search(r"hashpartitioning\(id#\w+, size#", plan)
