"""Tables that take repeated batches, memo keys and versions."""

import glob
import hashlib
import os

from pyspark.sql import functions as F

from corvella.operators import versions
from corvella.sources import tables


def files_of(path):
    return {f: hashlib.sha1(open(f, "rb").read()).hexdigest() for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "docs")
    schema = "doc_id string, version long, text string"
    first = [(f"d{i}", 1, f"text {i}") for i in range(40)] + [(None, 1, "no id")]
    tables.upsert(spark.createDataFrame(first, schema), path, "doc_id", "version", 8)
    before = files_of(path)
    assert len(before) == 8
    tables.upsert(spark.createDataFrame([("d3", 2, "newer"), ("d3", 1, "older"), ("d5", 0, "stale")], schema).where("doc_id = 'd3'"), path, "doc_id", "version", 8)
    after = files_of(path)
    assert len({f for f in before if before[f] != after.get(f)}) == 1 and len(after) == 8
    want = {r[0]: r[1:] for r in first} | {"d3": (2, "newer")}
    read = lambda: {r.doc_id: (r.version, r.text) for r in spark.read.parquet(path).collect()}
    assert read() == want
    tables.upsert(spark.createDataFrame([("d3", 2, "newer")], schema), path, "doc_id", "version", 8)
    tables.upsert(spark.createDataFrame([("d5", 0, "stale")], schema), path, "doc_id", "version", 8)
    assert read() == want and spark.read.parquet(path).count() == 41
    tables.upsert(spark.createDataFrame([("d7", 3, "wide", 5)], schema + ", n int"), path, "doc_id", "version", 8)
    got = {r.doc_id: r.n for r in spark.read.option("mergeSchema", True).parquet(path).collect()}
    assert got["d7"] == 5 and got["d1"] is None
    assert [r.text for r in tables.read_keys(spark, path, "doc_id", ["d9", "none"], 8).collect()] == ["text 9"]
    tables.upsert(spark.createDataFrame([], schema), path, "doc_id", "version", 8)


def test_dual_sink_replays_and_repairs_its_header(spark, tmp_path):
    log, table = str(tmp_path / "log"), str(tmp_path / "table")
    one = spark.createDataFrame([("questions", "a"), ("feedback", "b")], "tab string, question string")
    two = spark.createDataFrame([("questions", "c", "ios")], "tab string, question string, device string")
    for batch, n in ((one, 0), (two, 1), (one, 0), (two, 1)):
        tables.write_both(batch, n, log, table)
    rows = tables.read_tab(spark, table, "questions")
    assert {(r.question, r.device) for r in rows.collect()} == {("a", None), ("c", "ios")} and rows.count() == 2
    assert spark.read.json(log).count() == 3
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tab" in plan and "questions" in plan
    older = spark.createDataFrame([("feedback", "x")], "tab string, comment string")
    tables.write_both(older, 2, log, table)
    assert [c for c in tables.read_tab(spark, table, "feedback").columns if c not in ("tab", "batch")] == ["question", "device", "comment"]


def test_dual_sink_of_a_stream(spark, tmp_path):
    schema = "tab string, question string"
    for k in range(2):
        spark.createDataFrame([("questions", f"q{k}"), ("feedback", f"f{k}")], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        tables.dual_sink(spark.readStream.schema(schema).json(str(tmp_path / "in")), str(tmp_path / "log"), str(tmp_path / "table"), str(tmp_path / "cp"))
    assert {r.question for r in tables.read_tab(spark, str(tmp_path / "table"), "questions").collect()} == {"q0", "q1"}
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_ingest_puts_broken_files_aside(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    args = (str(folder), "document_id string, title string, n int", "document_id", str(tmp_path / "docs"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    first = {"a.json": '{"document_id": "1",\n "title": "x", "n": 3}', "b.json": '{"document_id": "2", ', "c.json": " ", "d.json": '{"title": "y"}', "e.json": '{"document_id": "5", "n": "many"}'}
    for name, text in first.items():
        (folder / name).write_text(text)
    tables.ingest_documents(spark, *args)
    (folder / "f.json").write_text('{"document_id": "6", "title": null}')
    for _ in range(2):
        tables.ingest_documents(spark, *args)
    assert {(r.document_id, r.title, r.n) for r in spark.read.parquet(str(tmp_path / "docs")).collect()} == {("1", "x", 3), ("6", None, None)}
    bad = {(os.path.basename(r.path), r.reason) for r in spark.read.parquet(str(tmp_path / "bad")).collect()}
    assert bad == {("b.json", "not json"), ("c.json", "empty"), ("d.json", "no document_id"), ("e.json", "not json")}


def test_a_renamed_title_misses_its_keys_only(spark):
    titles = [("soldier", 1, "leave"), ("soldier", 2, None), ("commander", 1, "leave")]
    schema = "role string, doc int, title string"
    requests = spark.createDataFrame([(r, f"q{i}") for r in ("soldier", "commander", "reserve") for i in range(4)] + [("soldier", "q0")], "role string, question string")
    digests = lambda rows: versions.catalogue_digest(spark.createDataFrame(rows, schema), ["role"], ["doc", "title"])
    keyed = versions.memo_keys(requests, digests(titles), "role", "question")
    none = spark.createDataFrame([], "memo_key string, answer string")
    misses = versions.memo_misses(keyed, none)
    assert misses.count() == 12
    cache = versions.memo_merged(none, misses.select("memo_key", F.col("question").alias("answer"))).cache()
    assert versions.memo_misses(versions.memo_keys(requests, digests(titles[::-1]), "role", "question"), cache).count() == 0
    renamed = [("soldier", 1, "leave"), ("soldier", 2, ""), ("commander", 1, "leave")]
    assert {r.role for r in versions.memo_misses(versions.memo_keys(requests, digests(renamed), "role", "question"), cache).collect()} == {"soldier"}
    assert versions.memo_merged(cache, cache.withColumn("answer", F.lit("other"))).where("answer = 'other'").count() == 0


def test_versions_are_kept(spark, tmp_path):
    path = str(tmp_path / "base")
    snap = lambda rows: spark.createDataFrame(rows, "page int, digest string, status int")
    tables.accept(snap([(1, "a", 200), (2, "b", 200), (3, "c", 404)]), path, 1, "status = 200")
    for _ in range(2):
        tables.accept(snap([(1, "x", 500), (2, "B", 200), (3, "c", 200)]), path, 2, "status = 200")
    held = tables.read_versions(spark, path)
    diff = lambda a, b: {r.page: r.status for r in versions.version_diff(held, "page", "digest", a, b).collect()}
    assert diff(1, 2) == {1: "ok", 2: "changed", 3: "new"} and diff(2, 1) == {1: "ok", 2: "changed", 3: "gone"} and diff(2, 2) == {1: "ok", 2: "ok", 3: "ok"}
    nxt = versions.accepted(held, snap([(1, "z", 200)]), "status = 200").collect()
    assert [(r.page, r.digest, r.version) for r in nxt] == [(1, "z", 3)]
