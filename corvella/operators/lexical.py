"""Lexical top-k over postings in order of impact.

Chunks are indexed in shards of bounded size as tasks meet them: one pass of an
automaton of all forms over each folded text tells which terms stand in it. A
shard has a list of its chunks for each term; a frequent term is one short list
a shard. What a term adds to a chunk's score is its weight, whatever the chunk,
so the bound of a list's blocks is the term's weight itself.

A query visits a shard's lists by falling weight. Once the lists to come cannot
lift a chunk that no list has named yet above the n-th best document, they are
no longer read through, only looked up for the chunks that can still get there.
A shard answers with n documents' rows at most, n x cap, whatever it holds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvella.functions import amounts
from corvella.functions import text as T

from .index import per_query_top, query_terms
from .stored import stored

SHARD_CHUNKS = 1 << 14
MOST_FORM_BYTES = 8 << 20  # of forms in one automaton; more forms take further passes
QUERIES_A_BLOCK = 512
MOST_SENT = 64 << 20


def _in_shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, most - n)
            held.append(part)
            n, at = n + part.num_rows, at + part.num_rows
            if n == most:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def build(chunks: DataFrame, terms: DataFrame, rules: T.Rules = T.NO_RULES, shard_chunks: int = SHARD_CHUNKS, form_bytes: int = MOST_FORM_BYTES) -> DataFrame:
    """shard, term, held, postings of chunks (chunk_id, doc_id, text), and a row a shard with its chunk ids and their documents.

    terms: term, forms. Chunks of a shard are numbered by document and id. A
    term stands in a chunk if one of its forms does, anywhere in the folded
    text. Null texts hold no terms.
    """
    told = chunks.select("chunk_id", "doc_id", T.fold(F.col("text"), rules).alias("text"))
    told = told.withColumn("task", F.spark_partition_id())
    distinct = stored(terms.select("term", "forms").distinct())
    size = distinct.agg(F.sum(F.octet_length("term") + F.aggregate("forms", F.lit(0), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    parts = max(1, -(-size // form_bytes))
    if parts > 1:  # each pass must meet the same rows in the same tasks
        told = stored(told)
    kind = {c: chunks.schema[c].dataType.simpleString() for c in ("chunk_id", "doc_id")}
    made = chunks.sparkSession.createDataFrame([], f"shard long, term string, held long, postings binary, ids array<{kind['chunk_id']}>, docs array<{kind['doc_id']}>").schema
    out = None
    for k in range(parts):
        mine = sorted((r.term, r.forms) for r in distinct.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == k).collect())  # form_bytes at most
        sent = chunks.sparkSession.sparkContext.broadcast(mine)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, first=not k) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton, of = ahocorasick.Automaton(), defaultdict(list)
            for i, (_, forms) in enumerate(sent.value):
                for form in forms:
                    of[form].append(i)
            for form, those in of.items():
                automaton.add_word(form, tuple(those))
            automaton.make_automaton()
            for number, shard in enumerate(_in_shards(batches, shard_chunks)):
                ids, docs = shard.column("chunk_id").to_pylist(), shard.column("doc_id").to_pylist()
                order = sorted(range(len(ids)), key=lambda i: (str(docs[i]), ids[i] is not None, ids[i]))
                texts = shard.column("text").to_pylist()
                found: dict[int, list[int]] = defaultdict(list)
                if of:
                    for at, i in enumerate(order):
                        seen = {those for _, those in automaton.iter(texts[i] or "")}
                        for t in {t for those in seen for t in those}:
                            found[t].append(at)
                name = shard.column("task")[0].as_py() << 32 | number
                rows = [(name, None, len(ids), None, [ids[i] for i in order], [docs[i] for i in order])] * first
                rows += [(name, sent.value[t][0], len(at), np.array(at, "<u4").tobytes(), None, None) for t, at in found.items()]
                if rows:
                    types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.list_(shard.schema.field("chunk_id").type), pa.list_(shard.schema.field("doc_id").type)]
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=made.fieldNames())

        part = told.mapInArrow(run, made)
        out = part if out is None else out.unionAll(part)
    return out


def frequencies(index: DataFrame, terms: DataFrame) -> DataFrame:
    """term, df: the number of chunks that hold it, 0 included."""
    found = index.where("term IS NOT NULL").groupBy("term").agg(F.sum("held").alias("df"))
    return terms.select("term").distinct().join(found, "term", "left").select("term", F.coalesce("df", F.lit(0)).cast("long").alias("df"))


class Lists:
    """A shard's chunks, numbered by document, and one query's lists over them."""

    def __init__(self, ids: list, docs: list):
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i]))
        self.n = len(ids)
        self.place = np.empty(self.n, np.int64)
        self.place[order] = np.arange(self.n)[::-1]  # higher goes first at equal scores
        new = [True, *(a != b for a, b in zip(docs, docs[1:]))]
        self.starts = np.flatnonzero(new)
        self.doc = np.cumsum(new) - 1

    def best(self, lists: list[tuple[int, np.ndarray]], n: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks and scores of the rows that can be among the n best with at most cap a document, over all shards."""
        lists = sorted(lists, key=lambda x: -x[0])
        left = sum(w for w, _ in lists)
        score = np.zeros(self.n, np.int64)
        least, live = 0, None
        for w, at in lists:
            if live is None:
                if left < least:  # nothing new can come in
                    live = np.flatnonzero(score + left >= least)
                else:
                    score[at] += w
                    left -= w
                    if len(self.starts) >= n:
                        tops = np.maximum.reduceat(score, self.starts)
                        least = int(np.partition(tops, len(tops) - n)[len(tops) - n])
                    continue
            live = live[score[live] + left >= least]
            k = np.minimum(np.searchsorted(at, live), len(at) - 1)
            score[live[at[k] == live]] += w
            left -= w
        key = np.where(score > 0, score * self.n + self.place, -1)
        tops = np.maximum.reduceat(key, self.starts)
        bound = max(0, int(np.partition(tops, len(tops) - n)[len(tops) - n])) if len(tops) >= n else 0
        rows = np.flatnonzero(key >= bound)
        rows = rows[np.lexsort((-key[rows], self.doc[rows]))]
        first = np.searchsorted(self.doc[rows], self.doc[rows])
        rows = rows[np.arange(len(rows)) - first < cap]
        return rows, score[rows]


def best_chunks(index: DataFrame, terms: DataFrame, n: int = 8, cap: int = 4, queries_a_block: int = QUERIES_A_BLOCK) -> DataFrame:
    """query_id, rank, doc_id, chunk_id, overlap: each query's n best chunks of a stored index, at most cap a document.

    terms: query_id, term, repeated as in the query. overlap: the matched
    terms' weights over the number of the query's terms. Equal overlaps rank by
    chunk_id.
    """
    spark = index.sparkSession
    shards = index.where("term IS NULL").select("shard", "ids", "docs")
    total = shards.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    counts = stored(terms.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times")))
    n_queries = counts.select("query_id").distinct().count()
    blocks = max(1, -(-n_queries // queries_a_block))
    weights = frequencies(index, terms).select("term", (4 * amounts.term_weight(F.col("df"), F.lit(total))).cast("int").alias("quarters"))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    asked = counts.join(weights, "term").where("quarters > 0").groupBy("term", block.alias("block")).agg(F.collect_list(F.struct("query_id", (F.col("quarters") * F.col("times")).alias("w"))).alias("who"))
    asked = stored(asked)
    sent = asked.agg(F.sum(64 + F.octet_length("term") + 48 * F.size("who"))).first()[0] or 0
    lists = index.where("term IS NOT NULL").select("shard", F.col("term").alias("of"), "postings")
    joined = lists.join(F.broadcast(asked) if sent <= MOST_SENT else asked, F.col("of") == F.col("term"))
    empty = {c: F.lit(None).cast(index.schema[c].dataType).alias(c) for c in ("ids", "docs")}
    rows = joined.select("shard", "block", "who", "postings", *empty.values())
    each = shards.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(None).cast(rows.schema["who"].dataType).alias("who"), F.lit(None).cast("binary").alias("postings"), "ids", "docs")
    rows = rows.unionByName(each).repartition("shard", "block").sortWithinPartitions("shard", "block")
    kind = {"query_id": terms.schema["query_id"].dataType, "chunk_id": index.schema["ids"].dataType.elementType, "doc_id": index.schema["docs"].dataType.elementType}
    made = spark.createDataFrame([], ", ".join(f"{k} {t.simpleString()}" for k, t in kind.items()) + ", quarters long").schema

    def answer(group: pa.Table) -> pa.RecordBatch | None:
        told = group.filter(pc.is_valid(group.column("ids")))
        ids, docs = told.column("ids")[0].as_py(), told.column("docs")[0].as_py()
        shard = Lists(ids, docs)
        of: dict = defaultdict(list)
        found = group.filter(pc.is_valid(group.column("postings")))
        for who, data in zip(found.column("who").to_pylist(), found.column("postings").to_pylist()):
            at = np.frombuffer(data, "<u4").astype(np.int64)
            for q in who:
                of[q["query_id"]].append((q["w"], at))
        out = [(q, ids[i], docs[i], s) for q, lists in of.items() for i, s in zip(*(x.tolist() for x in shard.best(lists, n, cap)))]
        types = [group.schema.field("who").type.value_type[0].type, group.schema.field("ids").type.value_type, group.schema.field("docs").type.value_type, pa.int64()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=made.fieldNames()) if out else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            keys = list(zip(batch.column("shard").to_pylist(), batch.column("block").to_pylist()))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                if held and keys[at] != last:
                    if (out := answer(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(at, end - at))
                last, at = keys[at], end
        if held and (out := answer(pa.Table.from_batches(held))) is not None:
            yield out

    n_terms = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    scored = rows.mapInArrow(run, made).join(n_terms, "query_id").withColumn("overlap", F.round(F.col("quarters") / 4 / F.col("n_terms"), 6))
    return per_query_top(scored, n, "overlap", ["chunk_id"], cap=cap).select("query_id", "rank", "doc_id", "chunk_id", "overlap")


def lexical_topk(queries: DataFrame, chunks: DataFrame, n: int = 8, cap: int = 4, rules: T.Rules = T.NO_RULES) -> DataFrame:
    """best_chunks of queries (query_id, text) over chunks (chunk_id, doc_id, text)."""
    terms = stored(query_terms(queries, rules))
    index = stored(build(chunks, terms, rules))
    return best_chunks(index, terms.select("query_id", "term"), n, cap)
