"""The best rows of groups, found in the tasks that score them."""

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from corvella.operators import dense
from corvella.plans import inputs, registered
from oracle import agree


def _made(spark, n=3000, partitions=3):
    dice = np.random.default_rng(5)
    vectors = np.round(dice.normal(size=(n, 4)), 1)  # many equal scores
    ids = random.Random(1).sample(range(10 * n), n)
    rows = [(i, [float(x) for x in v], i % 3 if i % 7 else None, i % 5) for i, v in zip(ids, vectors)]
    df = spark.createDataFrame(rows, "row_id long, embedding array<float>, doc_id int, n long").repartition(partitions)
    return df, df.where("row_id % 50 = 0").selectExpr("row_id AS query_id", "embedding")


def _groups(pairs, rows):
    of = {r.row_id: (r.doc_id, r.n) for r in rows.collect()}
    out = defaultdict(list)
    for r in pairs.collect():
        out[r.query_id, of[r.row_id][0]].append((-r.score, r.row_id, of[r.row_id][1]))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("most_held", [dense.MOST_HELD, 50])
def test_the_best_of_each_group_are_those_of_all_pairs(spark, most_held):
    rows, queries = _made(spark)
    every = _groups(dense.pair_scores(rows, queries), rows)
    some = _groups(dense.best_pairs(rows, queries, 4, ("doc_id",), most_held=most_held), rows)
    assert {k: v[:4] for k, v in some.items()} == {k: v[:4] for k, v in every.items()}
    assert all(set(v) <= set(every[k]) for k, v in some.items())


def test_tasks_pass_on_few_rows(spark):
    rows, queries = _made(spark)
    assert dense.best_pairs(rows, queries, 4, ("doc_id",)).count() <= queries.count() * 4 * 4 * 3


def test_rows_within_a_budget(spark):
    rows, queries = _made(spark)

    def within(of):
        out = {}
        for k, v in of.items():
            total, kept = 0, v[:1]
            for x in v[1:]:
                total += x[2]
                if total > 20:
                    break
                kept.append(x)
            out[k] = kept
        return out

    every = _groups(dense.pair_scores(rows, queries), rows)
    some = _groups(dense.best_pairs(rows, queries, 1, ("doc_id",), "n", 20), rows)
    assert within(some) == within(every)
    assert sum(map(len, some.values())) < sum(map(len, every.values())) / 4


@pytest.mark.parametrize("most_held", [dense.MOST_HELD, 3])
def test_rows_that_others_outdo_do_not_slip_into_a_budget(spark, most_held):
    # The second task knows nothing of the 36 words before its rows; if only 18 of them are passed on, its 1 + 1 seem to be in the budget of 20.
    tasks = [[(1, [9.0], 0, 0), (2, [8.0], 0, 9), (3, [7.0], 0, 9), (4, [6.0], 0, 9), (5, [5.0], 0, 9)], [(6, [2.0], 0, 1), (7, [1.0], 0, 1)]]
    rows = spark.createDataFrame(spark.sparkContext.parallelize(tasks, 2).flatMap(lambda x: x), "row_id long, embedding array<double>, doc_id int, n long")
    queries = spark.createDataFrame([(9, [1.0])], "query_id long, embedding array<double>")
    left = _groups(dense.best_pairs(rows, queries, 1, ("doc_id",), "n", 20, most_held=most_held), rows)[9, 0]
    total, within = 0, []
    for _, row, n in left:
        total += n
        within += [row] if total <= 20 else []
    assert within == [1, 2, 3]


@pytest.mark.parametrize("cut", [1700, 1900])
def test_budget_merge_over_uneven_tasks(spark, sf_dir, monkeypatch, cut):
    read = inputs.vectors  # of 2000 rows at sf0.1

    def uneven(*args):
        rows, queries = read(*args)
        return rows.where(rows.row_id < cut).coalesce(1).unionAll(rows.where(rows.row_id >= cut).repartition(2, "row_id")), queries

    monkeypatch.setattr(inputs, "vectors", uneven)
    agree(spark, os.path.join(os.path.dirname(sf_dir), "sf0.1"), *registered()["budget_merge"])


def test_scores_that_are_no_numbers_are_kept(spark):
    rows = spark.createDataFrame([(1, [float("nan")], 0), (2, [1e15], 0), (3, [2.0], 0), (4, [1.0], 0)], "row_id long, embedding array<double>, doc_id int")
    queries = spark.createDataFrame([(9, [1.0])], "query_id long, embedding array<double>")
    assert {r.row_id for r in dense.best_pairs(rows.coalesce(1), queries, 1, ("doc_id",)).collect()} == {1, 2, 3}


ALL_BUT_ASKED = {"hybrid_score"}  # scores rows that share words one by one


@pytest.mark.parametrize("name", ["folded_topk", "budget_merge", "layer_audit", "winner_depth", "hybrid_score", "budget_ablation", "reserved_merge", "hit_at_k", "stripped_ranks", "anchor_fold", "starvation", "distinct_sources", "self_retrieval", "query_contexts"])
def test_queries_do_not_shuffle_every_pair(spark, sf_dir, monkeypatch, name):
    used, best = [], dense.best_pairs

    def every_pair(*args, **kw):
        raise AssertionError("every pair leaves the scorer")

    monkeypatch.setattr(dense, "best_pairs", lambda *a, **kw: used.append(name) or best(*a, **kw))
    if name not in ALL_BUT_ASKED:
        monkeypatch.setattr(dense, "pair_scores", every_pair)
    agree(spark, sf_dir, *registered()[name])
    assert used
