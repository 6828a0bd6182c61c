"""Bounded scoring of rows against a batch of queries.

A score is the rounded dot product, plus a quarter of the lexical overlap, plus
a bonus for boosted documents, in whole thousandths. Only documents that can
reach a query's n best rows leave the scorer:

1. Tasks keep, for each query, the n best documents by their best real row and
   by their best anchor, whatever the number of rows they read. The n-th best
   document over all tasks bounds the n-th best row from below, as each
   document gives at least one row of its own best score.
2. Tasks name the documents with a row that reaches the bound. Documents whose
   best anchor reaches it must hold real rows to count.
3. The rows of these documents, about n for each query, meet their queries by
   document and are scored in full.

Queries go to tasks in blocks of bounded size; rows stay where they are in the
first two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ANCHOR
from .stored import stored

BLOCK_QUERIES = 4096
COLUMNS_AT_ONCE = 256  # queries of a score matrix
ROWS_AT_ONCE = 2048
CELLS_AT_ONCE = 1 << 20  # (row, query) cells that rows' terms are spread over at once
NEVER = -(1 << 40)  # below any score
SLACK = 2  # thousandths by which two products of the same vectors may round apart, twice


@dataclass
class Block:
    """Some queries: ids, vectors, and the queries that hold terms, for each term which of these hold it (from starts[t] on, places in asking) with 4 x weight; boosted (query, document) pairs; the bound to reach."""

    ids: np.ndarray
    vectors: np.ndarray
    terms: list[str]
    starts: np.ndarray
    who: np.ndarray
    weights: np.ndarray
    asking: np.ndarray
    n_terms: np.ndarray
    boosted: dict
    bound: np.ndarray | None = None


def thousandths(dense: np.ndarray, quarters: np.ndarray, n_terms: np.ndarray) -> np.ndarray:
    """Rounded dot product and a quarter of quarters / 4 / n_terms, each rounded (half up) to whole thousandths."""
    return np.round(dense * 1000).astype(np.int64) + np.where(n_terms > 0, (125 * quarters + n_terms) // (2 * np.maximum(n_terms, 1)), 0)


def bonus(quarters: Column, n_terms: Column) -> Column:
    """The lexical part of a score in thousandths, as thousandths() has it."""
    return F.coalesce(F.floor((125 * quarters + n_terms) / (2 * n_terms)), F.lit(0)).cast("long")


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _blocks(queries: DataFrame, boost: DataFrame | None, size: int, bound: DataFrame | None = None) -> Iterator[Broadcast]:
    """queries: query_id, embedding, terms (array<struct<term, quarters>>), n_terms. A block is as many queries as size says, with their terms."""
    spark = queries.sparkSession
    blocks = max(1, -(-queries.count() // size))
    for k in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        if boost is not None:
            part = part.join(boost.groupBy("query_id").agg(F.collect_set("doc_id").alias("boosted")), "query_id", "left")
        if bound is not None:
            part = part.join(bound.select("query_id", "bound"), "query_id", "left")
        got = part.toArrow()
        if not got.num_rows:
            continue
        held = got.column("terms").to_pylist()
        terms: dict[str, int] = {}
        cells = [(terms.setdefault(t["term"], len(terms)), q, t["quarters"]) for q, of in enumerate(held) for t in of or ()]
        cells.sort()
        of_term, of_query, weights = (np.array([c[i] for c in cells], np.int64) for i in range(3))
        asking, who = np.unique(of_query, return_inverse=True)
        starts = np.searchsorted(of_term, np.arange(len(terms) + 1))
        pairs: dict = {}
        for q, docs in enumerate(got.column("boosted").to_pylist() if boost is not None else ()):
            for d in docs or ():
                pairs.setdefault(d, []).append(q)
        least = np.array([NEVER if b is None else b for b in got.column("bound").to_pylist()], np.int64) if bound is not None else None
        ids = got.column("query_id").to_numpy()
        yield spark.sparkContext.broadcast(Block(ids, _vectors(got.column("embedding").combine_chunks()), list(terms), starts, who, weights, asking, got.column("n_terms").to_numpy().astype(np.int64), pairs, least))


def _quarters(held: pa.Array, block: Block) -> np.ndarray:
    """4 x weight of the terms that rows hold (held: lists), for the queries that hold terms: rows x asking. Works on a bounded number of cells at a time."""
    out = np.zeros((len(held), len(block.asking)), np.int32)
    sizes = pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = held.flatten()
    if not len(flat) or not block.terms:
        return out
    codes = pc.fill_null(pc.index_in(flat, value_set=pa.array(block.terms, flat.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(held)), sizes)[codes >= 0]
    codes = codes[codes >= 0]
    many = block.starts[codes + 1] - block.starts[codes]
    upto = np.cumsum(many)
    at = 0
    while at < len(codes):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] - many[at] + CELLS_AT_ONCE, side="right")))
        n = many[at:end]
        cell = np.arange(n.sum()) + np.repeat(block.starts[codes[at:end]] - (np.cumsum(n) - n), n)
        first = row[at]
        place = (np.repeat(row[at:end], n) - first) * len(block.asking) + block.who[cell]
        last = row[end - 1] + 1
        out[first:last] += np.bincount(place, block.weights[cell], (last - first) * len(block.asking)).astype(np.int32).reshape(last - first, -1)
        at = end
    return out


def _scored(batch: pa.RecordBatch, block: Block, lift: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first query, documents' places, scores of their best real rows, of their best anchors), for some queries at a time.

    A document's place is that of one of its rows in the batch. Scores: documents x queries.
    """
    rows = _vectors(batch.column("embedding"))
    coded = batch.column("doc_id").dictionary_encode(null_encoding="encode")
    names, place = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
    anchor = np.array(batch.column("anchor").to_numpy(zero_copy_only=False), bool)
    order = np.lexsort((anchor, place))
    group = 2 * place[order] + anchor[order]
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    at_doc, at_anchor = group[starts] // 2, group[starts] % 2 == 1
    one = np.empty(len(names), np.int64)
    one[place] = np.arange(len(place))
    asked = _quarters(batch.column("held"), block)
    boosted = [(i, block.boosted[d]) for i, d in enumerate(batch.column("doc_id").to_pylist()) if d in block.boosted and not anchor[i]]
    for q in range(0, len(block.ids), COLUMNS_AT_ONCE):
        width = min(COLUMNS_AT_ONCE, len(block.ids) - q)
        quarters = np.zeros((len(rows), width), np.int64)
        low, high = np.searchsorted(block.asking, (q, q + width))
        quarters[:, block.asking[low:high] - q] = asked[:, low:high]
        scores = thousandths(rows @ block.vectors[q : q + width].T, quarters, block.n_terms[q : q + width])
        for i, who in boosted:
            cols = [c - q for c in who if q <= c < q + width]
            scores[i, cols] += lift
        best = np.maximum.reduceat(scores[order], starts, axis=0)
        real, anchors = (np.full((len(names), width), NEVER) for _ in range(2))
        real[at_doc[~at_anchor]] = best[~at_anchor]
        anchors[at_doc[at_anchor]] = best[at_anchor]
        yield q, one, real, anchors


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS_AT_ONCE):
            yield b.slice(at, ROWS_AT_ONCE)


class Best:
    """The n best documents of each query so far. A document that comes again counts once."""

    def __init__(self, n: int, queries: int):
        self.score = np.full((n, queries), NEVER)
        self.doc = np.full((n, queries), -1)

    def add(self, first: int, score: np.ndarray, doc: np.ndarray) -> None:
        """score: documents x queries from first on; doc: numbers of the documents."""
        n, width = len(self.score), score.shape[1]
        here = slice(first, first + width)
        if len(score) > n:
            top = np.argpartition(-score, n - 1, axis=0)[:n]
            score, doc = np.take_along_axis(score, top, 0), doc[top]
        else:
            doc = np.broadcast_to(doc[:, None], score.shape)
        both, docs = np.concatenate([self.score[:, here], score]), np.concatenate([self.doc[:, here], doc])
        order = np.lexsort((-both, docs), axis=0)
        both, docs = np.take_along_axis(both, order, 0), np.take_along_axis(docs, order, 0)
        both[1:][docs[1:] == docs[:-1]] = NEVER
        top = np.argpartition(-both, n - 1, axis=0)[:n]
        self.score[:, here], self.doc[:, here] = np.take_along_axis(both, top, 0), np.take_along_axis(docs, top, 0)


def best_documents(rows: DataFrame, queries: DataFrame, n: int, boost: DataFrame | None = None, lift: int = 50, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, doc_id, score, anchor: the n best documents of each task by real rows and by anchors (anchor true).

    rows: row_id, doc_id, anchor (boolean), embedding, held (array of terms).
    """
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    out = None
    for sent in _blocks(queries, boost, block):

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            of, kinds = sent.value, None
            numbers: dict = {}
            names: list = []
            real, anchors = Best(n, len(of.ids)), Best(n, len(of.ids))
            for b in _batches(batches):
                kinds = b.column("doc_id").type
                given = b.column("doc_id").to_pylist()
                for q, place, r, a in _scored(b, of, lift):
                    if not q:
                        numbered = np.array([numbers.setdefault(given[i], len(numbers)) for i in place.tolist()])
                        names.extend(list(numbers)[len(names) :])
                    real.add(q, r, numbered)
                    anchors.add(q, a, numbered)
            if kinds is None:
                return
            for best, anchor in ((real, False), (anchors, True)):
                k, q = np.nonzero(best.score > NEVER)
                docs = pa.array([names[d] for d in best.doc[k, q].tolist()], kinds)
                yield pa.record_batch({"query_id": of.ids[q], "doc_id": docs, "score": best.score[k, q], "anchor": np.full(len(k), anchor)})

        found = rows.mapInArrow(run, f"query_id {query_type}, doc_id {doc_type}, score long, anchor boolean")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else rows.select(F.lit(None).cast(query_type).alias("query_id"), "doc_id", F.lit(0).cast("long").alias("score"), F.lit(False).alias("anchor")).limit(0)


def bounds(best: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """query_id, bound: the n-th best document's score, null if fewer are known. A document's anchors count if it has real rows."""
    real = rows.where(~F.col("anchor")).select("doc_id").distinct()
    counted = best.where(~F.col("anchor")).select("query_id", "doc_id", "score").unionByName(best.where("anchor").join(real, "doc_id", "left_semi").select("query_id", "doc_id", "score"))
    per = counted.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    nth = per.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))).where(F.col("at") <= n)
    return nth.groupBy("query_id").agg(F.max(F.when(F.col("at") == n, F.col("score"))).alias("bound"))


def reaching(rows: DataFrame, queries: DataFrame, bound: DataFrame, boost: DataFrame | None = None, lift: int = 50, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, doc_id: documents with a row that reaches their query's bound (less SLACK). A task names each once."""
    doc_type = rows.schema["doc_id"].dataType.simpleString()
    query_type = queries.schema["query_id"].dataType.simpleString()
    out = None
    for sent in _blocks(queries, boost, block, bound):

        def run(batches: Iterator[pa.RecordBatch], sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            of, told = sent.value, set()
            for b in _batches(batches):
                given = b.column("doc_id").to_pylist()
                new = []
                for q, place, real, anchors in _scored(b, of, lift):
                    d, c = np.nonzero(np.maximum(real, anchors) >= of.bound[q : q + real.shape[1]] - SLACK)
                    new += [(i + q, given[place[k]]) for k, i in zip(d.tolist(), c.tolist())]
                new = [x for x in dict.fromkeys(new) if x not in told]
                told.update(new)
                if new:
                    yield pa.record_batch({"query_id": of.ids[[i for i, _ in new]], "doc_id": pa.array([d for _, d in new], b.column("doc_id").type)})

        found = rows.mapInArrow(run, f"query_id {query_type}, doc_id {doc_type}")
        out = found if out is None else out.unionAll(found)
    return out.distinct() if out is not None else rows.select(F.lit(None).cast(query_type).alias("query_id"), "doc_id").limit(0)


def scored_rows(rows: DataFrame, queries: DataFrame, pairs: DataFrame, boost: DataFrame | None = None, lift: int = 50) -> DataFrame:
    """query_id, doc_id, row_id, score (thousandths): all rows of the documents of pairs (query_id, doc_id), scored for their queries."""
    met = rows.join(pairs, "doc_id").join(queries.select("query_id", F.col("embedding").alias("asked"), "terms", "n_terms"), "query_id")
    quarters = F.aggregate(F.filter("terms", lambda t: F.array_contains(F.col("held"), t["term"])), F.lit(0).cast("long"), lambda a, t: a + t["quarters"])
    told = met.select("query_id", "doc_id", "row_id", "anchor", "embedding", "asked", F.when(F.col("n_terms") > 0, bonus(F.coalesce(quarters, F.lit(0)), F.col("n_terms"))).otherwise(F.lit(0)).alias("bonus"))
    names = ["query_id", "doc_id", "row_id", "anchor"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                dense = (_vectors(b.column("embedding"))[:, None, :] @ _vectors(b.column("asked"))[:, :, None])[:, 0, 0]
                score = np.round(dense * 1000).astype(np.int64) + b.column("bonus").to_numpy()
                yield pa.record_batch([*[b.column(n) for n in names], pa.array(score)], names=[*names, "score"])

    made = told.select(*names, F.lit(0).cast("long").alias("score")).schema
    scored = told.mapInArrow(run, made)
    if boost is not None:
        mine = boost.select("query_id", "doc_id").distinct().withColumn("_b", F.lit(lift))
        scored = scored.join(mine, ["query_id", "doc_id"], "left").withColumn("score", F.col("score") + F.when(~F.col("anchor"), F.coalesce("_b", F.lit(0))).otherwise(0))
    return scored.select("query_id", "doc_id", "row_id", "score")


def candidate_hits(rows: DataFrame, queries: DataFrame, n: int, boost: DataFrame | None = None, lift: int = 50, block: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, doc_id, row_id, score: every row of the documents that can hold one of a query's n best rows.

    rows: row_id, doc_id, section, embedding, held (terms found in the row's
    text). queries: query_id, embedding, terms (array of struct<term,
    quarters>: 4 x weight x occurrences), n_terms. boost: query_id, doc_id;
    these documents' real rows gain lift.
    """
    rows = rows.select("row_id", "doc_id", (F.col("section") == ANCHOR).alias("anchor"), "embedding", "held")
    bound = stored(bounds(best_documents(rows, queries, n, boost, lift, block), rows, n))
    pairs = reaching(rows, queries, bound, boost, lift, block)
    real = rows.where(~F.col("anchor")).select("doc_id").distinct()
    return scored_rows(rows, queries, stored(pairs.join(real, "doc_id", "left_semi")), boost, lift)
