"""Dense scores: query vectors against all rows, in blocks.

Query vectors are sent to tasks in blocks of bounded size; each task scores a
batch of rows by one matrix product. Rows are never shuffled. Where only the
best rows of a group are asked for, tasks leave the others out before anything
is shuffled (best_pairs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_QUERIES = 4096
ROWS_AT_ONCE = 8192
MOST_HELD = 4_000_000  # pairs that a task holds before it passes them on
LARGEST = float(1 << 40)  # rows with scores beyond, or none that are numbers, are passed on whole


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def pair_scores(rows: DataFrame, queries: DataFrame, top: int | None = None, digits: int = 3, also: tuple[str, ...] = ()) -> DataFrame:
    """query_id, row_id, score: rounded dot products of rows (row_id, embedding) with queries (query_id, embedding). also: columns of rows that go along.

    top: a task returns only the best `top` rows of each batch for each query
    (equal scores: smaller row_id first), which is enough for a later top-k.
    """
    spark = rows.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // BLOCK_QUERIES))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["query_id long, row_id long, score double", *[f"`{c}` {kinds[c]}" for c in also]])
    out = None
    for k in range(blocks):
        part = queries.select("query_id", "embedding").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).orderBy("query_id").toArrow()
        sent = spark.sparkContext.broadcast((part.column("query_id").to_numpy(), _matrix(part.column("embedding").combine_chunks())))  # a block of queries

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            if not len(ids):
                return
            for whole in batches:
                for at in range(0, whole.num_rows, 1000):
                    b = whole.slice(at, 1000)
                    row = b.column("row_id").to_numpy()
                    scores = np.round(_matrix(b.column("embedding")) @ q.T, digits) + 0.0
                    for i in range(0, len(ids), 64):
                        s = scores[:, i : i + 64]
                        if top is None:
                            r, c = (x.ravel() for x in np.indices(s.shape))
                        else:
                            order = np.lexsort((np.broadcast_to(row[:, None], s.shape), -s), axis=0)[:top]
                            r, c = order.ravel(), np.broadcast_to(np.arange(s.shape[1]), order.shape).ravel()
                        of = {name: b.column(name).take(pa.array(r)) for name in also}
                        yield pa.record_batch({"query_id": ids[i : i + 64][c], "row_id": row[r], "score": s[r, c], **of})

        found = rows.select("row_id", "embedding", *also).mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out


class _Held:
    """Pairs (query, group, units, row, words) of which a group's best stay for each query: the first `keep`, and with words all up to the row that takes the words, less the first's, over the budget."""

    def __init__(self, keep: int, budget: int | None):
        self.keep, self.budget = keep, budget
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, first: int, group: int, units: np.ndarray, row: np.ndarray, words: np.ndarray | None) -> None:
        """units: queries from first on x rows of one group, in whole numbers. row: ascending."""
        m = units.shape[1]
        order = units * m + np.arange(m - 1, -1, -1)  # equal units: the smaller row first
        if words is not None:
            order = -np.sort(-order, axis=1)
        elif m > self.keep:
            order = np.partition(order, m - self.keep, axis=1)[:, m - self.keep :]
        score, at = order // m, m - 1 - order % m
        if words is None:
            q = np.repeat(np.arange(first, first + len(units)), order.shape[1])
            score, at = score.ravel(), at.ravel()
        else:
            n = words[at]
            before = np.cumsum(n, axis=1) - n
            there = (before - n[:, :1] <= self.budget) | (np.arange(m) < self.keep)
            q, _ = np.nonzero(there)
            q, score, at = q + first, score[there], at[there]
        self.parts.append((q, np.full(len(q), group), score, row[at], words[at] if words is not None else row[at]))
        self.size += len(q)

    def best(self) -> tuple[np.ndarray, ...]:
        q, group, score, row, words = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((row, -score, group, q))
        q, group, score, row, words = (x[order] for x in (q, group, score, row, words))
        new = np.append(True, (q[1:] != q[:-1]) | (group[1:] != group[:-1]))
        start = np.flatnonzero(new)[np.cumsum(new) - 1]
        there = np.arange(len(q)) - start < self.keep
        if self.budget is not None:
            total = np.cumsum(words)
            there |= total - words - total[start] <= self.budget
        self.parts = [tuple(x[there] for x in (q, group, score, row, words))]
        self.size = int(there.sum())
        return self.parts[0]

    def clear(self) -> None:
        self.parts, self.size = [], 0


def _whole(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of about that many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held += [b.slice(at, rows) for at in range(0, b.num_rows, rows)]
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def best_pairs(rows: DataFrame, queries: DataFrame, keep: int, by: tuple[str, ...], words: str | None = None, budget: int = 0, digits: int = 3, most_held: int = MOST_HELD) -> DataFrame:
    """query_id, row_id, score and the columns `by`: of pair_scores what a top-k by groups needs.

    For each query and group of rows (`by`) every task passes on the best
    `keep` rows it has read, equal scores by smaller row_id; so a cap of `keep`
    a group, or of any grouping of groups, finds all its rows. words: a column
    of numbers not below 0; of each group there come too the best rows while
    their words, those of a task's first left out, add up to no more than the
    budget, and the row that goes over it. So a running sum over what is passed
    on, with or without the first, is within the budget for the same rows as
    over all: rows after one that a task left out have more words than the
    budget before them here too. Tasks hold most_held pairs at most and may
    pass on rows that others outdo.
    """
    spark = rows.sparkSession
    n = queries.count()
    blocks = max(1, -(-n // BLOCK_QUERIES))
    columns = ["row_id", "embedding", *dict.fromkeys([*by, *([words] if words else [])])]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(["query_id long, row_id long, score double", *[f"`{c}` {kinds[c]}" for c in by]])
    out = None
    for k in range(blocks):
        part = queries.select("query_id", "embedding").where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k).orderBy("query_id").toArrow()
        sent = spark.sparkContext.broadcast((part.column("query_id").to_numpy(), _matrix(part.column("embedding").combine_chunks())))  # a block of queries

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            if not len(ids):
                return
            held, numbers, types = _Held(keep, budget if words else None), {}, []

            def told(query: np.ndarray, group: np.ndarray, score: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
                names = list(numbers)
                of = [pa.array([x[i] for x in names], t) for i, t in enumerate(types)]
                for at in range(0, len(query), 100_000):
                    s = slice(at, at + 100_000)
                    yield pa.record_batch([pa.array(ids[query[s]]), pa.array(row[s]), pa.array(score[s]), *[a.take(pa.array(group[s])) for a in of]], names=["query_id", "row_id", "score", *by])

            for b in _whole(batches, ROWS_AT_ONCE):
                b = b.take(pa.array(np.argsort(b.column("row_id").to_numpy(), kind="stable")))
                row, vectors, types = b.column("row_id").to_numpy(), _matrix(b.column("embedding")), [b.column(c).type for c in by]
                lists = [b.column(c).to_pylist() for c in by]
                group = np.array([numbers.setdefault(x, len(numbers)) for x in (zip(*lists) if by else [()] * len(row))])
                size = b.column(words).to_numpy() if words else None
                members = [(g, np.flatnonzero(group == g)) for g in np.unique(group)]
                for i in range(0, len(ids), 256):
                    units = np.rint((q[i : i + 256] @ vectors.T) * 10.0**digits)
                    plain = (np.abs(units) < LARGEST).all(axis=0)
                    for g, at in members:
                        at = at[plain[at]]
                        if len(at):
                            held.add(i, g, units[:, at].astype(np.int64), row[at], size[at] if words else None)
                    if not plain.all():
                        whole = np.flatnonzero(~plain)
                        c, r = (x.ravel() for x in np.indices((units.shape[0], len(whole))))
                        yield from told(c + i, group[whole][r], units[:, whole].ravel() / 10.0**digits + 0.0, row[whole][r])
                    if held.size > most_held:
                        found = held.best()
                        if 2 * held.size > most_held:
                            yield from told(found[0], found[1], found[2] / 10.0**digits, found[3])
                            held.clear()
            if held.size:
                found = held.best()
                yield from told(found[0], found[1], found[2] / 10.0**digits, found[3])

        found = rows.select(*columns).mapInArrow(run, schema)
        out = found if out is None else out.unionAll(found)
    return out


def embedding_misses(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts whose vector the cache (text_sha1, model, vector) lacks for that model."""
    keyed = texts.select("text", F.sha1("text").alias("text_sha1")).dropDuplicates(["text_sha1"])
    return keyed.join(cache.where(F.col("model") == model), "text_sha1", "left_anti")
