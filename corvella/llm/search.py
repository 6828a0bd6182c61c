"""Ranked lexical search: document-at-a-time merge over compressed postings.

Documents are indexed in shards of bounded size, as tasks meet them: a shard's
documents are numbered in the order of their ids, and each of its terms has a
list of (document, occurrences) in that order, as differences of the smallest
width that holds them. Nothing is shuffled to build the index, a shard holds at
most SHARD_BYTES of text or one longer text, and a frequent term is one list a
shard. Scores depend on counts over all documents only, so they are alike
however documents fall into shards.

A search deals queries over blocks. For each shard and block, the lists of a
query's terms are merged through a heap of their next documents, and a bounded
heap keeps the k best results by score, then document. Lists whose best
possible scores together cannot lift a document into that heap are no longer
merged, only asked about documents that other lists bring up; that skips no
result. The k best of all shards are merged at the end.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import partitions, runs_of, shared, text_chunks

TERM = re.compile(rb"[0-9a-z\x80-\xff]+")  # of lower-cased bytes
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SHARD_BYTES = 16 << 20  # of text
QUERIES_A_BLOCK = 512
MOST_SENT = 64 << 20  # bytes of query terms that may be broadcast; more meet the index in a shuffle join
BEST = 10


def terms(text: bytes | None) -> list[bytes]:
    return TERM.findall((text or b"").translate(LOWER))


def _narrow(values: np.ndarray) -> bytes:
    """The values, after a byte that tells their width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(values) or int(values.max()) < 1 << (8 * w))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(data: bytes, n: int) -> tuple[np.ndarray, bytes]:
    """n values, and what comes after them."""
    end = 1 + n * data[0]
    return np.frombuffer(data[1:end], f"<u{data[0]}").astype(np.int64), data[end:]


def packed(at: np.ndarray, times: np.ndarray) -> bytes:
    """Postings as bytes: differences of the documents' numbers, then occurrences less 1."""
    return _narrow(np.diff(at, prepend=0)) + _narrow(times - 1)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    steps, rest = _wide(data, n)
    return np.cumsum(steps), _wide(rest, n)[0] + 1


class Shard:
    """Postings of some documents, gathered in any order."""

    def __init__(self):
        self.names: dict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.sizes: list[int] = []
        self.term: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = terms(text)
        counts = Counter(found)
        self.term.append(np.fromiter(map(self.names.__getitem__, counts), np.int64, len(counts)))
        self.times.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.ids.append(doc_id)
        self.sizes.append(len(found))
        self.bytes += len(text or b"")

    def rows(self) -> tuple[list, list, Iterator[tuple[bytes, int, bytes]]]:
        """Ids and sizes of the documents by number, and (term, documents, postings)."""
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        term = np.concatenate(self.term)
        at = np.repeat(number, [len(t) for t in self.term])
        by = np.lexsort((at, term))
        at, times = at[by], np.concatenate(self.times)[by]
        ends = np.cumsum(np.bincount(term, minlength=len(self.names)))
        starts = np.append(0, ends[:-1])
        # Most terms are rare: their bytes are cut from those of all lists of one width.
        steps = np.diff(at, prepend=0)
        steps[starts[starts < len(at)]] = at[starts[starts < len(at)]]
        one, two, less = steps.astype("u1").tobytes(), steps.astype("<u2").tobytes(), (times - 1).astype("u1").tobytes()
        wide = np.where(np.maximum.reduceat(times, starts) > 256, 4, 1 + (np.maximum.reduceat(steps, starts) > 255)) if len(at) else starts

        def narrow(w: int, a: int, b: int) -> bytes:
            if w == 1:
                return b"\x01" + one[a:b] + b"\x01" + less[a:b]
            return b"\x02" + two[2 * a : 2 * b] + b"\x01" + less[a:b] if w == 2 and b - a < 1 << 16 and at[b - 1] < 1 << 16 else packed(at[a:b], times[a:b])

        lists = ((t, b - a, narrow(w, a, b)) for t, w, a, b in zip(self.names, wide.tolist(), starts.tolist(), ends.tolist()))
        return [self.ids[i] for i in order], [self.sizes[i] for i in order], lists


INDEX = "shard long, term binary, held long, postings binary, ids array<{id}>, sizes array<long>"
ROWS_OUT = 20_000  # of the index at a time


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The index of docs: a row a shard and term, and one a shard, without term, for its documents.

    Null texts hold no terms, as do empty ones; null ids come last within a
    shard; repeated rows and ids are documents of their own. Very long texts
    are taken whole, alone in a shard if need be. An empty table gives an
    empty index. Other columns, whatever their names, are not read.
    """
    made = docs.sparkSession.createDataFrame([], INDEX.format(id=docs.schema["doc_id"].dataType.simpleString())).schema
    names = made.fieldNames()

    def told(shard: Shard, name: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.list_(id_type), pa.list_(pa.int64())]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        ids, sizes, lists = shard.rows()
        yield batch([(name, None, len(ids), None, ids, sizes)])
        held = []
        for term, n, data in lists:
            held.append((name, term, n, data, None, None))
            if len(held) == ROWS_OUT:
                yield batch(held)
                held = []
        if held:
            yield batch(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, made, task, id_type = Shard(), count(), TaskContext.get().partitionId(), None
        for batch in batches:
            id_type = batch.column("doc_id").type
            for chunk in text_chunks(batch, "text"):
                for doc_id, text in zip(chunk.column("doc_id").to_pylist(), chunk.column("text").cast(pa.binary()).to_pylist()):
                    if shard.ids and shard.bytes + len(text or b"") > shard_bytes:
                        yield from told(shard, task << 32 | next(made), id_type)
                        shard = Shard()
                    shard.add(doc_id, text)
        if shard.ids:
            yield from told(shard, task << 32 | next(made), id_type)

    return docs.select("doc_id", "text").mapInArrow(run, made)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each item; rows of one id are one item."""
    made = items.sparkSession.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, terms array<binary>").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(set(terms(t))) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([batch.column("item_id"), pa.array(found, pa.list_(pa.binary()))], names=["item_id", "terms"])

    return items.select("item_id", "text").mapInArrow(run, made).select("item_id", F.explode("terms").alias("term")).distinct()


def best_documents(lists: list[tuple[list[int], list[int]]], k: int) -> list[tuple[int, int]]:
    """(score, document) of the k documents of highest score above 0, best first, ties by document.

    lists: documents in ascending order, and what each scores.
    """
    lists = sorted((x for x in lists if x[0]), key=lambda x: max(x[1]))
    most = [0, *accumulate(max(scores) for _, scores in lists)]  # that the first lists can score together
    place = [0] * len(lists)
    best: list[tuple[int, int]] = []  # (score, -document), a heap
    least = asked = 0  # the score to beat; lists that are asked only
    ahead: list[tuple[int, int]] = []  # (next document, list), a heap
    stale = True
    while True:
        if stale:
            while asked < len(lists) and most[asked + 1] <= least:
                asked += 1
            ahead = [(at[place[j]], j) for j, (at, _) in enumerate(lists) if j >= asked and place[j] < len(at)]
            heapq.heapify(ahead)
            stale = False
        if not ahead:
            return sorted(((s, -d) for s, d in best), key=lambda x: (-x[0], x[1]))
        doc, score = ahead[0][0], 0
        while ahead and ahead[0][0] == doc:
            j = ahead[0][1]
            at, scores = lists[j]
            score += scores[place[j]]
            place[j] += 1
            if place[j] < len(at):
                heapq.heapreplace(ahead, (at[place[j]], j))
            else:
                heapq.heappop(ahead)
        for j in range(asked - 1, -1, -1):
            if score + most[j + 1] <= least:
                break
            at, scores = lists[j]
            place[j] = bisect_left(at, doc, place[j])
            if place[j] < len(at) and at[place[j]] == doc:
                score += scores[place[j]]
        if score > least:
            if len(best) < k:
                heapq.heappush(best, (score, -doc))
            else:
                heapq.heapreplace(best, (score, -doc))
            if len(best) == k and best[0][0] > least:
                least, stale = best[0][0], most[min(asked + 1, len(lists))] <= best[0][0]


def weight(n: Column, held: Column) -> Column:
    return F.floor(1000 * F.log((2 * n + 2) / (2 * held + 1))).cast("long")


def search(index: DataFrame, items: DataFrame, k: int = BEST, queries_a_block: int = QUERIES_A_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k best documents of a written index.

    Items without terms (null or empty texts) and items whose terms no document
    holds have no rows. Null item ids are one item; rows of one item id are one
    item with the terms of them all. Equal scores rank by doc_id, null ids last.
    An empty index or no items give no rows. Only item_id and text of items are read.
    """
    spark = index.sparkSession
    documents = index.where("term IS NULL").select("shard", "ids", "sizes")
    n, total = documents.agg(F.sum(F.size(F.filter("sizes", lambda x: x > 0))), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()
    asked = shared(item_terms(items))
    blocks = max(1, -(-asked.select("item_id").distinct().count() // queries_a_block))
    by_term = asked.groupBy("term", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("item_id")).alias("items"))
    lists = index.where("term IS NOT NULL").select("shard", F.col("term").alias("of"), "held", "postings")
    # Query terms follow the items; their size is looked at before they are sent to all tasks.
    sent = by_term.agg(F.sum(64 + F.octet_length("term") + 32 * F.size("items"))).first()[0] or 0
    hint = F.broadcast if sent <= MOST_SENT else lambda df: df
    distinct = hint(by_term.select("term").distinct())
    held = lists.join(distinct, lists.of == distinct.term, "leftsemi").groupBy("of").agg(F.sum("held").alias("df"))
    weighted = by_term.join(held, by_term.term == held.of).select("term", "block", "items", weight(F.lit(n), F.col("df")).alias("w")).where("w > 0")
    weighted = hint(shared(weighted))
    name = (F.col("shard") * blocks + F.col("block")).alias("group")
    rows = lists.join(weighted, lists.of == weighted.term).select(name, "w", "items", "held", "postings", F.lit(None).cast(index.schema["ids"].dataType).alias("ids"), F.lit(None).cast("array<long>").alias("sizes"))
    shards = documents.select("shard", "ids", "sizes", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    nothing = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("w", "items", "held", "postings")}
    rows = rows.unionByName(shards.select(name, *nothing.values(), "ids", "sizes")).repartition(partitions(spark), "group").sortWithinPartitions("group")
    made = spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, doc_id {index.schema['ids'].dataType.elementType.simpleString()}, score long").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs_of(batches, "group"):
            item_type, id_type = group.schema.field("items").type.value_type[0].type, group.schema.field("ids").type.value_type
            told = group.filter(pc.is_valid(group.column("ids")))
            ids, sizes = told.column("ids")[0].as_py(), np.array(told.column("sizes")[0].as_py(), np.int64)
            m = 10 + (90 * sizes * n) // total
            of: dict = defaultdict(list)
            found = group.filter(pc.is_valid(group.column("postings")))
            for w, who, held, data in zip(*(found.column(c).to_pylist() for c in ("w", "items", "held", "postings"))):
                at, times = unpacked(data, held)
                merged = at.tolist(), (w * ((10**9 * times) // (1000 * times + 8 * m[at]))).tolist()
                for item in who:
                    of[item["item_id"]].append(merged)
            out = [(item, ids[doc], score) for item, lists in of.items() for score, doc in best_documents(lists, k)]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), (item_type, id_type, pa.int64()))], names=["item_id", "doc_id", "score"])

    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return rows.mapInArrow(run, made).withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search_documents(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """search over an index of docs, written to the shared folder first."""
    return search(shared(build_index(docs)), items, k)
