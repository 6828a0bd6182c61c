import hashlib

import corpus_pipeline


def test_stages_and_run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir).cache()
        assert kept.columns == docs.columns, name
        counts.append(kept.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert whole.count() == counts[-1]


def test_pipeline_result_against_library(spark, sf_dir):
    from tokenizers import Tokenizer

    from corvella.llm import queries

    tokenizer = Tokenizer.from_file(queries.vocabulary_path())
    kept = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    for r in kept.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].n_tokens == len(ids)


def test_empty_documents(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def test_repeated_rows_and_null_ids_keep_one_copy(spark, docs_of):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    rows = [(7, text["a"])] * 3 + [(5, text["b"]), (None, text["b"])] + [(None, text["c"])] * 2 + [(4, text["d"]), (4, "other words under the same id"), (2, text["d"])]
    docs = docs_of(rows).repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, "").cache()
    want = {(7, text["a"]), (5, text["b"]), (None, text["c"]), (4, "other words under the same id"), (2, text["d"])}
    assert kept.columns == docs.columns
    assert kept.count() == len(want) and {(r.doc_id, r.text) for r in kept.collect()} == want
    cut = corpus_pipeline.substring_dedup(spark, kept, "")
    assert cut.count() == len(want) and {(r.doc_id, r.text) for r in cut.collect()} == want


def test_stages_on_messy_rows(spark, docs_of, messy, sf_dir):
    """Nulls, empty, blank, very long and repeated texts, repeated ids and columns that clash with the operators' own."""
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").first().text
    docs = docs_of([*messy, (20, item), (20, item), (None, f"before {item} after")])
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    every = rows(docs)
    known = stages["language_id"](spark, docs, sf_dir)
    assert known.columns == docs.columns
    letters = [x for x in every if x[1] and any(c.isalpha() for c in x[1])]
    assert set(rows(known)) <= set(letters) and all(every.count(x) == rows(known).count(x) for x in set(rows(known)))
    clean = stages["benchmark_decontamination"](spark, docs, sf_dir)
    assert clean.columns == docs.columns and rows(clean) == [x for x in every if item not in (x[1] or "")]
    coded = stages["tokens"](spark, docs, sf_dir).collect()
    assert len(coded) == len(every) and sorted(str(r.doc_id) for r in coded) == sorted(str(i) for i, _ in every)
    assert all(r.n_tokens == 0 for r in coded if r.doc_id in (1, 2, 3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == docs_of([]).columns, name
    assert stages["tokens"](spark, docs, sf_dir).count() == docs.count()
