"""Acceptance counts, shares of rows, lists, guarded pages, files of orders."""

import random

from pyspark.sql import functions as F

from corvella.functions import text as T
from corvella.operators import curation, evaluation, experiments, extraction, intake, logs, sampling
from corvella.sources import files


def test_six_anchors_must_survive(spark):
    asked = spark.createDataFrame([(d,) for d in ("a", "b", "c")], "doc_id string")
    accepted = spark.createDataFrame([("a", i) for i in range(6)] + [("b", i) for i in range(5)], "doc_id string, n int")
    assert {(r.doc_id, r.n_kept, r.ok) for r in curation.anchor_verdict(accepted, asked).collect()} == {("a", 6, True), ("b", 5, False), ("c", 0, False)}


def test_a_quarter_of_the_rows(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "k")
    got = {r.k for r in experiments.some_of(rows, "k").collect()}
    assert 0.23 < len(got) / 20_000 < 0.27
    assert got == {r.k for r in experiments.some_of(rows.repartition(7), "k").collect()}
    assert got != {r.k for r in experiments.some_of(rows, "k", seed=8).collect()}
    assert experiments.some_of(rows, "k", 0).count() == 0 and experiments.some_of(rows, "k", 100).count() == 20_000


def test_strata_are_bounded_before_the_shuffle(spark):
    rows = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, "rare").otherwise("hot").alias("s"))
    got = sampling.stratified(rows, "k", "s", {"hot": 30, "rare": 12, "none": 5})
    assert {r.s: r["count"] for r in got.groupBy("s").count().collect()} == {"hot": 30, "rare": 12}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_probe_counts_the_whole_pool(spark):
    rows = [(i, "blind" if i < 30 else "other" if i < 60 else "inside_out", "yellow" if i % 2 else "green") for i in range(90)]
    df = spark.createDataFrame(rows, "id long, source string, band string")
    got = {r.source: r["count"] for r in experiments.probe_sample(df, 24).groupBy("source").count().collect()}
    assert got == {"blind": 15, "inside_out": 9}
    got = {r.source: r["count"] for r in experiments.probe_sample(df, 1000).groupBy("source").count().collect()}
    assert got == {"blind": 15, "inside_out": 15}


def test_lists(spark):
    df = spark.createDataFrame([(" a, b ,,c ", [True, False, True], 2), (None, None, 2), ("", [True], 3)], "t string, b array<boolean>, n int")
    assert [r[0] for r in df.select(T.comma_list(F.col("t"))).collect()] == [["a", "b", "c"], [], []]
    assert [r[0] for r in df.select(T.of_length(F.col("b"), F.col("n"), F.lit(False))).collect()] == [[True, False], [False, False], [True, False, False]]


def test_jsonl_overwrite_and_append(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = spark.createDataFrame([(1,), (2,)], "n int")
    files.write_jsonl(rows, path)
    files.write_jsonl(rows, path)
    assert files.read_jsonl(spark, path, "n int").count() == 2
    files.write_jsonl(rows, path, append=True)
    assert files.read_jsonl(spark, path, "n int").count() == 4
    assert files.read_jsonl(spark, str(tmp_path / "none"), "n int").count() == 0


def test_strata_without_a_sample(spark):
    population = spark.createDataFrame([("a",)] * 6 + [("b",)] * 3 + [("c",)], "stratum string")
    sample = spark.createDataFrame([("a", "full"), ("a", "none")], "stratum string, outcome string")
    assert {tuple(r) for r in evaluation.unmeasured(sample, population).collect()} == {("b", 3, 0.3), ("c", 1, 0.1)}
    assert {r.outcome: r.rate for r in evaluation.stratified_rate(sample, population).collect()} == {"full": 0.3, "none": 0.3}


def test_pages_of_other_words_are_told(spark):
    rng = random.Random(1)
    docs, pages = [], []
    for d in range(60):
        words = [rng.choice(["a", "b", "c", "dd"]) for _ in range(rng.randint(0, 30))]
        cut = sorted(rng.randint(0, len(words)) for _ in range(3))
        parts = [words[i:j] for i, j in zip([0, *cut], [*cut, len(words)])]
        how = d % 5
        if how == 1 and len(words) > 1:
            parts[0], parts[-1] = parts[-1], parts[0]
        if how == 2 and words:
            parts[-1] = parts[-1] + ["a"]
        docs.append((d, "  ".join(words)))
        pages += [(d, p, "\n".join(x)) for p, x in enumerate(parts)]
    want = {d for d, t in docs if t.split() == [w for i, _, x in pages if i == d for w in x.split()]}
    got = extraction.matching_pages(spark.createDataFrame(pages, "doc_id int, page int, text string"), spark.createDataFrame(docs, "doc_id int, text string"))
    assert {r.doc_id for r in got.collect()} == want and 20 < len(want) < 60


def test_files_of_an_order(spark):
    base = spark.createDataFrame([("o1", "a", "1"), ("o1", "b", "2"), ("o2", "a", "1"), ("o3", "a", "1"), ("o4", "a", "1"), ("o5", None, None)], "k string, path string, digest string")
    now = spark.createDataFrame([("o1", "a", "9", None), ("o1", "c", "3", None), ("o2", "a", "1", None), ("o3", "a", None, "timeout"), ("o4", "a", "1", "timeout"), ("o4", "z", "1", "timeout"), ("o9", "a", "1", None)], "k string, path string, digest string, error string")
    got = {r.k: (r.status, r.gone, r.added, r.failed, r.changed) for r in intake.file_status(base, now, "k").collect()}
    assert got == {"o1": ("changed", ["b"], ["c"], [], ["a"]), "o2": ("ok", [], [], [], []), "o3": ("error", [], [], ["a"], []), "o4": ("changed", [], ["z"], ["a"], []), "o5": ("ok", [], [], [], [])}


def test_a_title_counts_twice(spark):
    words = spark.createDataFrame([(1, "sleep"), (2, "sleep"), *((d, "other") for d in range(3, 40))], "doc_id int, word string")
    asked = spark.createDataFrame([(1, "sleep")], "query_id int, term string")
    got = spark.createDataFrame([(1, 1)], "query_id int, doc_id int")
    titles = spark.createDataFrame([(2, "sleep")], "doc_id int, word string")
    known = words.select("word").distinct()
    assert logs.triage(asked, known, words, 40, got).first().cause == "answer"
    assert logs.triage(asked, known, words, 40, got, titles=titles).first().cause == "retrieval"


def test_anchors_against_loop(spark):
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]
    plain = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 2))
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))
    questions = [(d, p, rng.choice([text(), text(), "  " + text() + "\n x", None, "weapon " + text()])) for d in range(12) for p in range(rng.randint(1, 25))]
    existing = [(d, text()) for d in range(0, 12, 2) for _ in range(2)]
    evals = [(i, text()) for i in range(4)]
    documents = [(d, "a weapon here" if d % 3 == 0 else "nothing", "gun" if d % 3 == 1 else None) for d in range(12)]
    families = [["weapon", "gun"], ["money"]]
    got = curation.anchor_check(
        spark.createDataFrame(questions, "doc_id int, pos int, question string"), spark.createDataFrame(documents, "doc_id int, raw_text string, block string"), spark.createDataFrame(existing, "doc_id int, question string"),
        spark.createDataFrame(evals, "id int, text string"), families, most=5, stems=plain,
    )
    stems = lambda q: {w for w in " ".join((q or "").split()).split(" ") if len(w) > 2}
    close = lambda a, b: len(a & b) / len(a | b) if a and b else 0
    want = {}
    for d, raw, block in documents:
        seen, kept = [stems(q) for e, q in existing if e == d], 0
        source = f"{raw}\n{block or ''}"
        for _, p, q in sorted((x for x in questions if x[0] == d), key=lambda x: x[1]):
            s, plain_q = stems(q), " ".join((q or "").split())
            if len((q or "").strip()) < 12:
                v = "short"
            elif any(close(s, stems(e)) >= 0.55 for _, e in evals):
                v = "mirror"
            elif any(close(s, e) >= 0.8 for e in seen):
                v = "duplicate"
            elif any(any(t in plain_q for t in f) and not any(t in source for t in f) for f in families):
                v = "topic"
            else:
                seen.append(s)
                kept += 1
                v = "kept" if kept <= 5 else "beyond"
            want[d, p] = (plain_q, v)
    assert {(r.doc_id, r.pos): (r.question, r.verdict) for r in got.collect()} == want
    assert {v for _, v in want.values()} >= {"short", "mirror", "duplicate", "topic", "kept", "beyond"}


def test_grounding_with_topics(spark):
    documents = spark.createDataFrame([("a", "the word of the order"), ("b", "the word of the gun")], "doc_id string, raw_text string")
    clauses = spark.createDataFrame([("a", 1, "the word"), ("a", 2, "a gun ] }"), ("b", 1, "the gun"), ("c", 1, "x")], "doc_id string, number int, text string")
    plain = lambda c: F.array_distinct(F.split(c, " "))
    got = curation.grounding_verdict(clauses, documents, {"weapons": ["gun", "rifle"], "money": ["pay"]}, stems=plain)
    assert {r.doc_id: (r.problems, r.topics, r.ok) for r in got.collect()} == {"a": (["2:debris", "2:ungrounded"], ["weapons"], False), "b": ([], [], True)}
