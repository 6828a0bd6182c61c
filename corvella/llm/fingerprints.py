"""Document fingerprints by spot signatures.

At each common word (an anchor) a chain of the next content words forms a
signature; so does the start of a text, which gives every text with a word at
least one. A fingerprint is the set of a text's signatures, 32 bits each,
written as ascending 8-digit hex numbers in a row. Likeness is the Jaccard
index of two sets; sets whose sizes alone keep it below a threshold are not
compared.

The near-duplicate join deals equal sets out once and partitions the others by
length: a pair that reaches the threshold has lengths so close that it lies in
one partition or in two that adjoin. Signatures are ordered, those of few texts
first; two such sets share one of the first few of either, so within a partition
they meet by one of these. A bucket of sets that share a signature gives a forest
of links, found by size-pruned Jaccard; large buckets are dealt out in tiles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from .cluster import partitions, runs_of, shared, text_chunks
from .components import components
from .words import NOT_ALNUM, U, Words, mix

CHAIN = 2
SPARSE = 20  # words for which a text should have an anchor
THRESHOLD = 0.8
TILE = 2000  # sets of a large bucket that one task compares with as many others
OFTEN = 1000  # signatures are counted in tasks; those of a thousandth of a task's sets or more are ordered last
# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that it for on with as was be by this are or an at from not have which "
    "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "le la les de des et un une du que en est pour qui dans par sur au pas avec ce il elle ne "
    "el los las y del se con una su para lo como más pero sus"
).split()
_ANCHOR_HASHES = np.unique(Words(pa.array(ANCHORS), NOT_ALNUM).hash)


def signature_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct signatures of each text."""
    words = Words(pc.utf8_lower(pa.array(texts, pa.large_string())), NOT_ALNUM)
    n = len(words.hash)
    if not n:
        return [np.zeros(0, np.uint32)] * len(texts)
    doc = words.doc()
    at = np.minimum(np.searchsorted(_ANCHOR_HASHES, words.hash), len(_ANCHOR_HASHES) - 1)
    common = _ANCHOR_HASHES[at] == words.hash
    bare = np.bincount(doc[~common], minlength=len(texts)) == 0  # texts of common words alone chain those
    content = np.flatnonzero(~common | bare[doc])
    heads = words.at[:-1][words.counts > 0]
    spots = np.concatenate([np.flatnonzero(common), heads])
    owner = doc[spots]
    value = np.concatenate([words.hash[common], np.full(len(heads), 0x5EED, U)])
    first = np.searchsorted(content, np.concatenate([np.flatnonzero(common) + 1, heads]))
    found = np.zeros(len(spots), bool)
    for k in range(CHAIN):
        i = np.minimum(first + k, len(content) - 1)
        here = (first + k < len(content)) & (doc[content[i]] == owner)
        value = np.where(here, mix(value * U(0x9DDFEA08EB382D69) + words.hash[content[i]], k), value)
        found |= here
    owner, value = _all_of_anchorless(words, doc, common, owner[found], value[found])
    signature = (mix(value, 31) >> U(32)).astype(np.int64)
    pairs = np.unique((owner.astype(np.int64) << 32) | signature)
    cuts = np.searchsorted(pairs >> 32, np.arange(len(texts) + 1))
    values = (pairs & 0xFFFFFFFF).astype(np.uint32)
    return [values[a:b] for a, b in zip(cuts, cuts[1:])]


def _all_of_anchorless(words: Words, doc: np.ndarray, common: np.ndarray, owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds each word with its successor, for texts with fewer than one anchor in SPARSE words: their few spots would not cover the text."""
    anchors = np.bincount(doc[common], minlength=words.n)
    sparse = anchors * SPARSE < words.counts
    at = np.flatnonzero(sparse[doc[:-1]] & (doc[:-1] == doc[1:])) if len(doc) > 1 else np.zeros(0, np.int64)
    chained = mix(words.hash[at] * U(0x9DDFEA08EB382D69) + words.hash[at + 1], 5) if len(at) else np.zeros(0, U)
    return np.concatenate([owner, doc[at]]), np.concatenate([value, chained])


def written(signatures: np.ndarray) -> str:
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray, at_least: float = 0.0) -> float:
    """Jaccard index of two sets; 1 for two empty ones; 0 where it must be below at_least."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < at_least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    found = both / (len(a) + len(b) - both)
    return found if found >= at_least else 0.0


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def cut_at(cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First (rank, tie) of each block but the lowest, from quantiles of the ranks. A rank that is several quantiles holds many rows: those are cut by their ties."""
    ranks, times = np.unique(np.array(cuts or [0], np.int64), return_counts=True)
    lowest, span = -(1 << 63), 1 << 64
    pairs = [(r, lowest + span * j // n) for r, n in zip(ranks.tolist(), times.tolist()) for j in range(n)]
    return np.array([r for r, _ in pairs], np.int64), np.array([t for _, t in pairs], np.int64)


def block_of(bounds: tuple[np.ndarray, np.ndarray], rank: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """The number of bounds at or below each (rank, tie)."""
    at = np.searchsorted(bounds[0], rank, "left")
    end = np.searchsorted(bounds[0], rank, "right")
    for i in np.flatnonzero(end > at).tolist():
        at[i] += np.searchsorted(bounds[1][at[i] : end[i]], tie[i], "right")
    return at.astype(np.int32)


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """block, late, doc_id, text: docs cut into ranges of (id, text hash), each with the next range's first row added.

    Within a block, by (late, doc_id, tie), each row but the last is followed by
    its successor in the order of ids; the last row of all is followed by the
    first. Null ids come first; equal ids are ordered by a text hash.
    """
    lowest = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"rank": F.coalesce("doc_id", F.lit(lowest)), "tie": F.xxhash64("text")})
    cuts = rows.agg(F.percentile_approx("rank", [i / blocks for i in range(1, blocks)] or [0.5], 10_000).alias("cuts")).first().cuts
    bounds = cut_at(cuts)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block = block_of(bounds, b.column("rank").to_numpy(), b.column("tie").to_numpy())
            yield pa.record_batch({"block": pa.array(block), "rank": b.column("rank"), "tie": b.column("tie")})

    firsts = rows.select("rank", "tie").mapInArrow(least, "block int, rank long, tie long").groupBy("block").agg(F.min(F.struct("rank", "tie")).alias("first")).orderBy("block").collect()
    # A row a block: `blocks` at most.
    before = {(r.first.rank, r.first.tie): firsts[i - 1].block for i, r in enumerate(firsts)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank, tie = b.column("rank").to_numpy(), b.column("tie").to_numpy()
            block = block_of(bounds, rank, tie)
            extra = [i for i, k in enumerate(zip(rank.tolist(), tie.tolist())) if k in before]
            for at, where, late in ((None, block, False), (extra, np.array([before[int(rank[i]), int(tie[i])] for i in extra], np.int32), True)):
                part = b if at is None else b.take(pa.array(at, pa.int64()))
                if part.num_rows:
                    yield pa.record_batch({"block": pa.array(where), "late": pa.array(np.full(len(where), late)), "rank": part.column("rank"), "tie": part.column("tie"), "doc_id": part.column("doc_id"), "text": part.column("text")})

    dealt = rows.select("rank", "tie", "doc_id", "text").mapInArrow(deal, "block int, late boolean, rank long, tie long, doc_id long, text string")
    return dealt.repartitionById(blocks, "block").sortWithinPartitions("block", "late", "rank", "tie").select("block", "late", "doc_id", "text")


def length_bounds(least: int, most: int, threshold: float) -> list[int]:
    """First lengths of partitions from least to most: each is 1 / threshold times as long as the one before, so a pair lies in one or in adjoining ones."""
    out = [max(1, least)]
    while out[-1] <= most:
        out.append(int(out[-1] / threshold) + 1)
    return out


def bucket_links(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A forest of links of sets that reach the threshold; sets already linked are not compared."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    flat = np.concatenate([sets[i] for i in order]) if len(sets) else np.zeros(0, np.uint32)
    starts = np.cumsum(sizes) - sizes
    root = np.arange(len(sets))
    links = []
    for i in range(len(sets)):
        end = int(np.searchsorted(sizes, sizes[i] / threshold + 1e-9, "right"))  # longer ones can't reach it
        rest = np.flatnonzero(root[i + 1 : end] != root[i]) + i + 1
        if not len(rest):
            continue
        a, b = starts[rest[0]], starts[rest[-1]] + sizes[rest[-1]]
        hit = np.isin(flat[a:b], flat[starts[i] : starts[i] + sizes[i]])
        both = np.concatenate([[0], np.cumsum(hit)])
        both = both[starts[rest] + sizes[rest] - a] - both[starts[rest] - a]
        for j in rest[both >= threshold * (sizes[i] + sizes[rest] - both) - 1e-9].tolist():
            if root[j] != root[i]:
                links.append((order[i], order[j]))
                root[root == root[j]] = root[i]
    return links


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and class_id of every row: the smallest doc_id over links of texts whose signature sets have a Jaccard index of threshold or more.

    Texts without words, null ones too, are one class. Null ids are kept but are
    never the smallest. Repeated rows come back repeated; an empty table gives
    no rows; other columns of docs are ignored. A very long text comes alone;
    its set is as long as it has common words.
    """
    spark = docs.sparkSession
    n = partitions(spark)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                found = [s.tobytes() for s in signature_sets([t or "" for t in chunk.column("text").to_pylist()])]
                yield pa.record_batch({"doc_id": chunk.column("doc_id"), "signatures": pa.array(found, pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sets_of, "doc_id long, signatures binary")
    rows = shared(rows.withColumn("key", F.md5("signatures")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    nodes = shared(rows.groupBy("key").agg(first.alias("o"), F.first("signatures").alias("signatures")).select("key", F.struct("o.no_id", "o.doc_id", "key").alias("node"), "signatures"))
    sizes = nodes.agg(F.min(F.octet_length("signatures")), F.max(F.octet_length("signatures"))).first()
    bounds = np.array(length_bounds((sizes[0] or 4) // 4, (sizes[1] or 4) // 4, threshold))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = {}, 0
        for batch in batches:
            found, times = np.unique(np.frombuffer(b"".join(batch.column("signatures").to_pylist()), np.uint32), return_counts=True)
            total += batch.num_rows
            for s, k in zip(found[times > max(1, batch.num_rows // OFTEN)].tolist(), times[times > max(1, batch.num_rows // OFTEN)].tolist()):
                seen[s] = seen.get(s, 0) + k
        kept = sorted((s, k) for s, k in seen.items() if k * OFTEN >= total)
        yield pa.record_batch({"signature": pa.array([s for s, _ in kept], pa.int64()), "times": pa.array([k for _, k in kept], pa.int64())})

    # Signatures that are frequent over all: at most OFTEN times a set's size of them.
    total = nodes.count()
    often = nodes.select("signatures").mapInArrow(count, "signature long, times long").groupBy("signature").agg(F.sum("times").alias("times")).where(F.col("times") * OFTEN >= total).orderBy("times", "signature").collect()
    sent = spark.sparkContext.broadcast((bounds, np.array([r.signature for r in often], np.uint32)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, last = sent.value
        place = {s: i + 1 for i, s in enumerate(last.tolist())}
        for batch in batches:
            at, parts, signatures, visits = [], [], [], []
            for i, data in enumerate(batch.column("signatures").to_pylist()):
                s = np.frombuffer(data, np.uint32)
                if not len(s):
                    continue
                rank = mix(s.astype(U), 41) >> U(1)
                if len(last):
                    frequent = np.array([place.get(x, 0) for x in s.tolist()], U)
                    rank = np.where(frequent > 0, (U(1) << U(63)) + frequent, rank)
                head = s[np.argsort(rank)][: len(s) - int(np.ceil(threshold * len(s) - 1e-9)) + 1]
                own = int(np.searchsorted(bounds, len(s), "right"))
                for part, visit in ((own, False), (own + 1, True)):
                    at += [i] * len(head)
                    parts += [part] * len(head)
                    signatures.append(head)
                    visits += [visit] * len(head)
            if at:
                rows = batch.select(["node", "signatures"]).take(pa.array(at))
                yield pa.record_batch({"part": pa.array(parts, pa.int32()), "signature": pa.array(np.concatenate(signatures).astype(np.int64)), "visit": pa.array(visits), "node": rows.column("node"), "signatures": rows.column("signatures")})

    node = nodes.schema["node"].dataType
    dealt_type = StructType([StructField("part", IntegerType()), StructField("signature", LongType()), StructField("visit", BooleanType()), StructField("node", node), StructField("signatures", BinaryType())])
    dealt = nodes.select("node", "signatures").mapInArrow(deal, dealt_type)
    # Buckets of one set link nothing; those of more than TILE are cut into tiles that meet pairwise.
    narrow = nodes.select("node", "signatures").mapInArrow(deal, dealt_type).groupBy("part", "signature").agg(F.count(F.lit(1)).alias("held"), F.count_if("visit").alias("visitors"))
    real = narrow.where((F.col("held") > 1) & (F.col("visitors") < F.col("held"))).select(F.col("part").alias("p"), F.col("signature").alias("s"), F.ceil(F.col("held") / TILE).cast("int").alias("tiles"))
    met = dealt.join(real, (F.col("part") == F.col("p")) & (F.col("signature") == F.col("s")))
    tile = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda k: F.struct(F.least(k, tile).alias("a"), F.greatest(k, tile).alias("b")))
    met = met.select("part", "signature", F.explode(pairs).alias("t"), "node", "signatures").withColumn("bucket", F.xxhash64("part", "signature", "t"))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs_of(batches, "bucket"):
            if t.num_rows < 2:
                continue
            found = bucket_links([np.frombuffer(x, np.uint32) for x in t.column("signatures").to_pylist()], threshold)
            if found:
                nodes = t.column("node").combine_chunks()
                yield pa.record_batch({"a": nodes.take(pa.array([a for a, _ in found])), "b": nodes.take(pa.array([b for _, b in found]))})

    met = met.select("bucket", "node", "signatures").repartition(n, "bucket").sortWithinPartitions("bucket")
    links = met.mapInArrow(link, StructType([StructField("a", node), StructField("b", node)]))
    member = components(links).select(F.col("node.key").alias("of"), F.col("component.doc_id").alias("least"))
    classes = nodes.select("key", "node").join(member, F.col("key") == F.col("of"), "left").select(F.col("key").alias("of"), F.coalesce("least", "node.doc_id").alias("class_id"))
    return rows.join(classes, F.col("key") == F.col("of")).select("doc_id", "class_id")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_with_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text and of its edited version, and likenesses to that and to the next text.

    The next text is that of the next doc_id (after the last: the first; a
    single row is its own next). Null texts are empty; empty texts have the
    empty fingerprint, 1 like another empty one and 0 like any other. Repeated
    rows come back repeated; an empty table gives no rows; other columns of
    docs are ignored. Very long texts are read whole, two at a time.
    """
    blocks = 2 * partitions(docs.sparkSession)

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """rows: (doc_id, text), the last one only as the next of the one before."""
        texts = [t for _, t in rows]
        changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
        own, other = signature_sets(texts), signature_sets(changed)
        n = len(changed)
        return pa.record_batch({
            "doc_id": pa.array([d for d, _ in rows[:n]], pa.int64()),
            "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in changed],
            "fingerprint": [written(s) for s in own[:n]],
            "edited_fingerprint": [written(s) for s in other],
            "near_edited": pa.array([likeness(a, b) for a, b in zip(own, other)], pa.float64()),
            "near_next": pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64()),
        })

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, at, closed = 0, None, False
        for batch in batches:
            for block, late, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("block", "late", "doc_id", "text"))):
                if block != at:
                    if len(held) > 1:
                        yield finish(held)
                    held, size, at, closed = [], 0, block, False
                if closed:  # of repeated first rows one is enough
                    continue
                closed = late
                held.append((doc_id, text))
                size += len(text)
                if size > 1_000_000 and len(held) > 1:
                    yield finish(held)
                    held = held[-1:]
                    size = len(text)
        if len(held) > 1:
            yield finish(held)

    return in_blocks(docs, blocks).mapInArrow(run, RESULT)
