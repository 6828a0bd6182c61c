"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are 64-bit SimHashes of 4-word shingles. Distinct fingerprints
are dealt out by pigeonhole blocks: two that differ in k bits or fewer agree
on at least one of k + 1 blocks of bits, so every link is inside some bucket.
Within a bucket they are sorted by Gray rank and indexed as a tree whose nodes
hold the bits that all their members share; a child stores only bits that its
parent does not. A search adds up differences from the root down and leaves a
whole group as soon as they exceed k.

A bucket returns a forest of links, not pairs: neighbours in Gray order are
linked first, and a group that already hangs together with the query is
skipped. Components over all buckets come from rounds of star contraction.
A fingerprint's node there is (smallest id, fingerprint), so the least node of a
component is its label and no component is ever grouped in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .cluster import partitions, row_keys, runs_of, shared
from .components import components

BITS, DISTANCE, SHINGLE = 64, 4, 4
LEAF, FAN = 32, 8
MOST_IN_BUCKET = 1 << 16  # fingerprints that one task indexes at once
MOST_SENT = 1 << 20  # names of large buckets, 16 bytes each, that are sent to all tasks
U = np.uint64


def simhash(text: str | None, size: int = SHINGLE) -> int:
    """Fingerprint of a text; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(size, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    counts, n = np.zeros(BITS, np.int64), len(starts)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 65_536):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + 65_536], ends[i : i + 65_536])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), key and key2 (the row's content keys) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), size) for t in b.column("text")), U, b.num_rows)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": pa.array(fps.view(np.int64)), "key": b.column("key"), "key2": b.column("key2")})

    doc_id = F.col("doc_id").cast("long")
    key, key2 = row_keys(doc_id, F.col("text"))
    return docs.select(doc_id.alias("doc_id"), "text", key.alias("key"), key2.alias("key2")).mapInArrow(run, "doc_id long, fp long, key long, key2 long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of x in the reflected Gray order."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> U(s))
    return x


class GrayIndex:
    """Levels of (bits, mask) patterns over fingerprints sorted by Gray rank; the last level is the root's."""

    def __init__(self, fps: np.ndarray):
        self.order = np.argsort(gray_rank(fps))
        self.fps = fps[self.order]
        n = len(self.fps)
        self.bounds = [np.arange(0, n, LEAF)]
        self.levels = [self._pattern(np.bitwise_and.reduceat(self.fps, self.bounds[0]), np.bitwise_or.reduceat(self.fps, self.bounds[0]))]
        while len(self.levels[-1][0]) > FAN:
            bits, mask = self.levels[-1]
            at = np.arange(0, len(bits), FAN)
            ones = np.bitwise_and.reduceat(bits & mask, at)
            zeros = np.bitwise_and.reduceat(~bits & mask, at)
            self.bounds.append(self.bounds[-1][at])
            self.levels.append((ones, ones | zeros))

    @staticmethod
    def _pattern(ones: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ones, ones | ~some

    def links(self, distance: int = DISTANCE, chunk: int = 256) -> np.ndarray:
        """For each sorted fingerprint the place of the first one in its component."""
        fps, n = self.fps, len(self.fps)
        near = np.bitwise_count(fps[1:] ^ fps[:-1]) <= distance
        label = np.maximum.accumulate(np.where(np.concatenate([[True], ~near]), np.arange(n), 0))
        for i in range(0, n, chunk):
            q = np.arange(i, min(i + chunk, n))
            for a, b in self._search(q, label, distance):
                label = _merge(label, label[a], label[b])
        return label

    def _search(self, q: np.ndarray, label: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links of the queries q to members of other components."""
        fps, n = self.fps, len(self.fps)
        top = len(self.levels) - 1
        at, node = (x.ravel() for x in np.meshgrid(q, np.arange(len(self.levels[top][0])), indexing="ij"))
        apart = np.zeros(len(at), np.uint8)
        outer = np.zeros(len(at), U)
        for level in range(top, -1, -1):
            bits, mask = self.levels[level]
            starts = self.bounds[level]
            low, high = np.minimum.reduceat(label, starts), np.maximum.reduceat(label, starts)
            apart = apart + np.bitwise_count((fps[at] ^ bits[node]) & (mask[node] & ~outer))
            # Later members only, as each pair is met from its earlier end; and not what hangs together already.
            ends = np.append(starts[1:], n)
            keep = (apart <= distance) & (ends[node] > at) & ~((low[node] == high[node]) & (low[node] == label[at]))
            at, node, apart = at[keep], node[keep], apart[keep]
            if not len(at):
                return
            if level:
                outer = np.repeat(mask[node], FAN)
                at, apart = np.repeat(at, FAN), np.repeat(apart, FAN)
                node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                real = node < len(self.levels[level - 1][0])
                at, node, apart, outer = at[real], node[real], apart[real], outer[real]
        for i in range(0, len(at), 32_768):
            a, leaf = at[i : i + 32_768], node[i : i + 32_768]
            b = (leaf[:, None] * LEAF + np.arange(LEAF)).ravel()
            a = np.repeat(a, LEAF)
            real = b < n
            a, b = a[real], b[real]
            hit = np.bitwise_count(fps[a] ^ fps[b]) <= distance
            hit &= label[a] != label[b]
            if hit.any():
                yield a[hit], b[hit]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components a[i] and b[i]; a component's label is its smallest place."""
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = root.get(up, up)
            x = up
        return x

    for x, y in pairs.T.tolist():
        x, y = find(x), find(y)
        root[max(x, y)] = min(x, y)
    if not root:
        return label
    olds = np.array(sorted(root))
    news = np.array([find(x) for x in olds.tolist()])
    i = np.minimum(np.searchsorted(olds, label), len(olds) - 1)
    return np.where(olds[i] == label, news[i], label)


def blocks_of(distance: int, n: int, most: int = 4096) -> list[list[tuple[int, int]]]:
    """Sets of (shift, width) bit blocks; any two fingerprints within distance agree on all of some set.

    Of distance + t blocks at least t agree. t grows with n so that a bucket
    would hold about `most` evenly spread fingerprints.
    """
    from itertools import combinations

    t = 1
    while n / 2 ** (BITS * t / (distance + t)) > most and t < 4:
        t += 1
    m = distance + t
    edges = [BITS * i // m for i in range(m + 1)]
    return [list(c) for c in combinations([(a, b - a) for a, b in zip(edges, edges[1:])], t)]


def further_blocks(mask: int, distance: int) -> list[int]:
    """The mask with each of distance + 1 blocks of its free bits added; any two fingerprints that agree under it, within distance, agree under one of these."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    edges = [len(free) * i // (distance + 1) for i in range(distance + 2)]
    return [mask | sum(1 << i for i in free[a:b]) for a, b in zip(edges, edges[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> BITS - 1 else mask


def buckets(fps: DataFrame, distance: int = DISTANCE, most: int = MOST_IN_BUCKET) -> DataFrame:
    """fp, node and bucket: distinct fingerprints (fp, node) dealt so that any two within distance meet in some bucket.

    A bucket is a mask of bits and their values. Sizes are counted before any
    bucket is brought together: one with more than `most` fingerprints is dealt
    again by blocks of its free bits, until none is left. With f free bits a bucket
    holds 2 ** f fingerprints at most, so this ends whatever the fingerprints are.
    """
    spark = fps.sparkSession
    n = fps.count()
    masks = [sum(((1 << width) - 1) << shift for shift, width in parts) for parts in blocks_of(distance, n)]
    dealt = fps.select("fp", "node", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask"))
    bucket = F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("bucket")  # two in one by chance do no harm
    done = None
    while n > most:
        dealt = dealt.select("fp", "node", "mask", bucket)
        sizes = dealt.groupBy("mask", "bucket").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > most)
        big = shared(sizes.where(F.bit_count(F.bitwise_not("mask")) >= most.bit_length()).select(F.col("mask").alias("of_mask"), F.col("bucket").alias("of_bucket")))
        counted = {r.of_mask: r.many for r in big.groupBy("of_mask").agg(F.count(F.lit(1)).alias("many")).collect()}  # masks: few
        if not counted:
            break
        if sum(counted.values()) <= MOST_SENT:
            big = F.broadcast(big)
        same = (F.col("mask") == F.col("of_mask")) & (F.col("bucket") == F.col("of_bucket"))
        small = dealt.join(big, same, "left_anti").select("fp", "node", "bucket")
        done = small if done is None else done.unionAll(small)
        finer = [(m, [_signed(x) for x in further_blocks(m % (1 << BITS), distance)]) for m in counted]
        finer = F.broadcast(spark.createDataFrame(finer, "from_mask long, finer array<long>"))
        again = dealt.join(big, same, "left_semi").join(finer, F.col("mask") == F.col("from_mask"))
        dealt = shared(again.select("fp", "node", F.explode("finer").alias("mask")))
    rest = dealt.select("fp", "node", bucket)
    return rest if done is None else done.unionAll(rest)


def bucket_links(fps: DataFrame, distance: int = DISTANCE, most: int = MOST_IN_BUCKET) -> DataFrame:
    """Links (a, b) of the nodes of distinct fingerprints (fp, node), a forest for each bucket: fewer than the fingerprints times the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs_of(batches, "bucket"):
            if t.num_rows < 2:
                continue
            index = GrayIndex(t.column("fp").to_numpy().view(U))
            label = index.links(distance)
            inner = np.flatnonzero(label != np.arange(len(label)))
            if len(inner):
                node = t.column("node").combine_chunks()
                yield pa.record_batch({"a": node.take(pa.array(index.order[inner])), "b": node.take(pa.array(index.order[label[inner]]))})

    dealt = buckets(fps, distance, most).repartition(partitions(fps.sparkSession), "bucket").sortWithinPartitions("bucket", "fp")
    kind = fps.schema["node"].dataType
    return dealt.select("bucket", "fp", "node").mapInArrow(run, StructType([StructField("a", kind), StructField("b", kind)]))


def labelled(nodes: DataFrame, distance: int) -> DataFrame:
    """fp, node and component (the least node linked, itself included) of distinct fingerprints (fp, node)."""
    member = components(bucket_links(nodes.select("fp", "node"), distance)).select(F.col("node.fp").alias("of"), "component")
    return nodes.select("fp", "node").join(member, nodes.fp == member.of, "left").select("fp", "node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, size: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component_id of every row.

    component_id: the smallest doc_id reached over links of fingerprints that
    differ in `distance` bits or fewer. Texts without words, null ones too,
    have the fingerprint zero and link like any other. Null ids are kept but
    are never the smallest; repeated rows come back repeated; an empty table
    gives no rows; other columns of docs are ignored. A very long text comes
    alone and whole; only its fingerprint goes on.
    """
    prints = shared(fingerprints(docs, size).select("doc_id", "fp"))
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    nodes = shared(prints.groupBy("fp").agg(owner.alias("o"), F.count(F.lit(1)).alias("rows")).select("fp", F.struct("o.no_id", "o.doc_id", "fp").alias("node"), "rows"))
    smallest = shared(labelled(nodes, distance).select(F.col("fp").alias("of"), F.col("component.doc_id").alias("component_id")))
    # Fingerprints of a thousandth of the rows or more, so a thousand of them at most, are sent to all tasks; the others are joined by shuffle.
    often = nodes.where(F.col("rows") >= max(100, prints.count() / 1000)).select(F.col("fp").alias("often"))
    hot = F.broadcast(smallest.join(F.broadcast(often), F.col("of") == F.col("often"), "left_semi"))
    rare = prints.join(hot, prints.fp == hot.of, "left_anti").join(smallest, prints.fp == smallest.of, "left")
    return prints.join(hot, prints.fp == hot.of).select("doc_id", "fp", "component_id").unionAll(rare.select("doc_id", "fp", "component_id"))


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each group of near-duplicates; columns, of any names, unchanged.

    It is the one with the smallest id, where null ids come last and rows of
    one id are ordered by their content keys. Of rows alike in id and text one
    is left. Texts without words, null ones too, are one group. An empty table
    gives no rows. Very long texts are read whole.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "key2"))
    nodes = shared(fingerprints(docs).groupBy("fp").agg(first.alias("o")).select("fp", F.struct("o.*", "fp").alias("node")))
    kept = labelled(nodes, distance).where("node = component").select(F.col("node.key").alias("of"), F.col("node.key2").alias("of2"))
    key, key2 = row_keys(F.col("doc_id").cast("long"), F.col("text"))
    # Repeated rows become one in each task first, so that any number of them meets as a row a task.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key.alias("key"), key2.alias("key2")).dropDuplicates(["key", "key2"])
    return rows.join(kept, (F.col("key") == F.col("of")) & (F.col("key2") == F.col("of2")), "left_semi").select("row.*")
