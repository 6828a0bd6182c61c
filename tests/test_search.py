"""Lexical top-k and the bounded scorer against slow versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators import index, lexical, ranking, scorer
from corvella.plans import retrieve as plan


def ranked(rows, n, cap):
    """The n best of (score, chunk, doc), at most cap a document, ties by chunk."""
    out, held = [], Counter()
    for score, chunk, doc in sorted(rows, key=lambda r: (-r[0], r[1])):
        held[doc] += 1
        if held[doc] <= cap and len(out) < n:
            out.append((chunk, doc, score))
    return out


@pytest.mark.parametrize("shard_chunks,form_bytes,block", [(1 << 14, 8 << 20, 512), (7, 60, 3)])
def test_lexical_topk_against_slow_version(spark, shard_chunks, form_bytes, block):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["Alpha", "alphabet", "w1w2"]
    text = lambda n, top: " ".join(rng.choice(words[:top]) for _ in range(n))
    chunks = [(f"c{i:03}", rng.choice(["a", "b", f"d{i % 40}"]), text(rng.randint(0, 12), rng.choice([4, 20, 33]))) for i in range(300)] + [("c999", "a", None)]
    queries = [(q, text(rng.randint(0, 6), 33)) for q in range(25)] + [(50, "unheard of"), (51, None)]
    terms = index.query_terms(spark.createDataFrame(queries, "query_id int, text string"))
    df = spark.createDataFrame(chunks, "chunk_id string, doc_id string, text string")
    built = lexical.build(df, terms, shard_chunks=shard_chunks, form_bytes=form_bytes).cache()
    got = defaultdict(list)
    for r in lexical.best_chunks(built, terms.select("query_id", "term"), 6, 2, block).orderBy("rank").collect():
        got[r.query_id].append((r.chunk_id, r.doc_id, r.overlap))
    weights = {r.term: r.weight for r in index.term_weights(terms, df.select("chunk_id", "text")).collect()}
    asked = defaultdict(list)
    for r in terms.collect():
        asked[r.query_id].append(r)
    for q, ts in asked.items():
        rows = [(round(sum(weights[t.term] for t in ts if any(f in (text or "").lower() for f in t.forms)) / len(ts), 6), c, d) for c, d, text in chunks]
        want = ranked([r for r in rows if r[0] > 0], 6, 2)
        assert [(c, d) for c, d, _ in got[q]] == [(c, d) for c, d, _ in want], q
        assert np.allclose([s for *_, s in got[q]], [s for *_, s in want])
    assert {r.term: r.df for r in lexical.frequencies(built, terms).collect()} == {r.term: r.df for r in index.document_frequency(terms, df.select("chunk_id", "text")).collect()}


def test_a_shard_answers_with_few_rows():
    rng = np.random.default_rng(2)
    docs = sorted(int(d) for d in rng.integers(0, 3000, 20_000))
    shard = lexical.Lists([f"{i:06}" for i in range(20_000)], docs)
    for _ in range(20):
        lists = [(int(rng.integers(1, 7)), np.unique(rng.integers(0, 20_000, rng.choice([5, 500, 15_000])))) for _ in range(8)]
        rows, scores = shard.best(lists, 8, 4)
        full = np.zeros(20_000, np.int64)
        for w, at in lists:
            full[at] += w
        assert len(rows) <= 32 and (full[rows] == scores).all()
        want = ranked([(int(full[i]), f"{i:06}", docs[i]) for i in np.flatnonzero(full)], 8, 4)
        assert ranked([(int(s), f"{i:06}", docs[i]) for i, s in zip(rows.tolist(), scores.tolist())], 8, 4) == want


def batch(spark, rng, n_rows, n_queries, dims=6):
    sections = ["sq", "key-facts", "key-facts2", "chunk0", "chunk1", "chunk2"]
    rows = [(i, rng.choice([i // 5, 3, 7]), rng.choice(sections), i % 5, f"title\n{' '.join(rng.choice(['common', 'rare', f'w{i % 9}', 'the']) for _ in range(4))}", [round(rng.gauss(0, 0.5), 2) for _ in range(dims)]) for i in range(n_rows)]
    chunks = spark.createDataFrame(rows, "row_id long, doc_id long, section string, pos long, text string, embedding array<double>")
    queries = [(q, rng.choice(["rare w3", "common w1 the", "", None]), [round(rng.gauss(0, 0.5), 2) for _ in range(dims)]) for q in range(n_queries)]
    return rows, chunks, queries, spark.createDataFrame(queries, "query_id long, text string, embedding array<double>")


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 3)])
def test_candidates_give_the_same_result_as_all_rows(spark, seed, block, monkeypatch):
    monkeypatch.setattr(scorer, "COLUMNS_AT_ONCE", 4)
    rng = random.Random(seed)
    rows, chunks, _, queries = batch(spark, rng, 260, 9)
    boost = spark.createDataFrame([(q, 10 + q) for q in range(9)] + [(1, 3)], "query_id long, doc_id long")
    full, held = plan.asked(queries, chunks)
    few = scorer.candidate_hits(held, full, 6, boost, block=block).cache()
    pairs = full.select("query_id").crossJoin(chunks.select("doc_id").distinct())
    every = scorer.scored_rows(held.select("row_id", "doc_id", (F.col("section") == "sq").alias("anchor"), "embedding", "held"), full, pairs, boost).cache()
    assert set(map(tuple, few.collect())) <= set(map(tuple, every.collect()))
    assert few.count() < every.count()

    def final(hits):
        told = hits.join(chunks.select("row_id", "section", "pos"), "row_id").withColumn("score", F.col("score") / 1000)
        return sorted(map(tuple, ranking.winner_depth(ranking.fold_anchors(told), 6).select("query_id", "rank", "row_id", "score", "lifted").collect()))

    assert final(few) == final(every)


def test_scores_against_slow_version(spark):
    rng = random.Random(8)
    rows, chunks, asked, queries = batch(spark, rng, 60, 5)
    full, held = plan.asked(queries, chunks)
    pairs = full.select("query_id").crossJoin(chunks.select("doc_id").distinct())
    got = {(r.query_id, r.row_id): r.score for r in scorer.scored_rows(held.select("row_id", "doc_id", (F.col("section") == "sq").alias("anchor"), "embedding", "held"), full, pairs).collect()}
    terms = index.query_terms(queries)
    weights = {r.term: r.weight for r in index.term_weights(terms, chunks.select(F.col("row_id").alias("chunk_id"), "text")).collect()}
    for q, text, e in asked:
        ts = [w for w in (text or "").split() if len(w) >= 3]
        for i, _, _, _, body, v in rows:
            quarters = round(sum(4 * weights[t] for t in ts if t in body))
            want = round(1000 * sum(a * b for a, b in zip(e, v))) + ((125 * quarters + len(ts)) // (2 * len(ts)) if ts else 0)
            assert abs(got[q, i] - want) <= 1


def test_few_rows_leave_the_scorer(spark):
    """One query over very many rows."""
    n = 200_000
    rows = spark.range(0, n, 1, 4).select(F.col("id").alias("row_id"), F.expr("id div 100").alias("doc_id"), (F.col("id") % 50 == 49).alias("anchor"), F.array(*[((F.xxhash64("id", F.lit(k)) % 1000) / 1000) for k in range(4)]).alias("embedding"), F.array().cast("array<string>").alias("held"))
    query = spark.createDataFrame([(1, [0.3, -0.2, 0.5, 0.1], [], 0)], "query_id long, embedding array<double>, terms array<struct<term:string,quarters:int>>, n_terms long")
    best = scorer.best_documents(rows, query, 8).cache()
    assert best.count() <= 2 * 8 * 4
    bound = scorer.bounds(best, rows, 8)
    assert 8 <= scorer.reaching(rows, query, bound).count() <= 20
    hits = scorer.candidate_hits(rows.withColumn("section", F.when(F.col("anchor"), "sq").otherwise("chunk")), query, 8)
    assert hits.count() <= 20 * 100


def test_retrieve_passes_over_documents_that_cannot_reach(spark):
    rng = random.Random(3)
    _, chunks, _, queries = batch(spark, rng, 200, 4)
    found, merged = plan.retrieve_and_merge(queries, chunks, 5, budget=40)
    got = found.collect()
    assert all(r.section != "sq" for r in got) and {r.query_id for r in got} == {0, 1, 2, 3}
    for q in range(4):
        scores = [r.score for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])]
        assert scores == sorted(scores, reverse=True) and len(scores) >= 5
    assert plan.passages(found, chunks, merged).count() > 0
    assert T.NO_RULES.prefixes == ""
