"""Substring dedup of repeated word windows behind a count-min prefilter.

A window is `size` consecutive words of one document. Each window holds an
anchor: its leftmost smallest-hashed run of ANCHOR words. Equal windows have
equal anchors at equal offsets, and two places of a window give two places of
its anchor, so an anchor's count is never below its windows' counts.

1. Every task sends, to the segment of each of its anchors, the anchor with its
   count in the task, and asks for those that it saw once. A segment merges
   these partition sketches into a count-min sketch of two rows of cells and
   then answers: which anchors are estimated to occur twice. The sketch is never
   gathered; segments grow in number with the text, a segment's memory does not.
   Anchors seen twice in a task need no answer.
2. Windows with such anchors are shuffled by anchor as runs of window hashes and
   grouped by them: 96 bits from two hashes of the words' bytes, each under a key
   of its own that is drawn for the run. No text can be made to meet another under
   keys that are not known, and by chance some 10^28 pairs of windows meet once. Windows that repeat within a task are sent once, so
   a passage in a third of all documents gives each task's group one row. The
   windows of anchors that would fill a quarter of a segment, which the sketch
   tells, are dealt by window hash.
3. The repeated spans go back to their documents, which are cut. Marks of anchors
   and spans meet the texts by one key, so one shuffle of the texts serves both.
"""

from __future__ import annotations

import hashlib
import secrets
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from .cluster import byte_length, partitions, row_keys, runs_of, shared, text_chunks
from .words import U, Words, mix, rolling

WINDOW, ANCHOR = 35, 16
SEGMENT_BYTES = 512 << 20  # of text a sketch segment: at most 2 x 32 million cells
GROUP_BYTES = 3 << 20  # of text a group segment
FLUSH_WINDOWS = 500_000  # that a task holds at once
FLUSH_ANCHORS = 500_000
SPAN = 1 << 20
KEY = np.dtype([("ref", "<i8"), ("ref2", "<i8")])
SHORT = (1 << 48) - 1  # anchors and refs travel to sketch segments as 48 bits: what happens to share them gives further estimates only


def _short(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Anchored:
    """Windows of the texts, and the runs of consecutive windows that share an anchor's place."""

    def __init__(self, texts: pa.Array, size: int, anchor: int, key: bytes):
        self.words = words = Words(texts, key=key)
        self.key = key
        self.window = np.flatnonzero(words.fits(size)) if len(words.hash) >= size else np.zeros(0, np.int64)
        grams = rolling(words.hash, anchor)
        place = np.arange(len(grams))
        width, span = 1, size - anchor + 1
        while width < span:  # leftmost smallest of `span` grams, by doubling
            step = min(width, span - width)
            later = grams[step:] < grams[:-step]
            place = np.where(later, place[step:], place[:-step])
            grams = np.where(later, grams[step:], grams[:-step])
            width += step
        anchors, place = grams[self.window], place[self.window]
        new = np.ones(len(self.window), bool)
        new[1:] = place[1:] != place[:-1]
        self.starts = np.flatnonzero(new)
        self.lengths = np.diff(np.append(self.starts, len(new)))
        self.anchor = anchors[self.starts]
        first = self.window[self.starts]
        self.doc = np.searchsorted(words.at, first, "right") - 1
        self.pos = first - words.at[self.doc]

    def hashes(self, size: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each window: 64 and 32."""
        if not len(windows):
            return np.zeros(0, U), np.zeros(0, np.uint32)
        return rolling(self.words.hash, size)[windows], (rolling(self.words.hashes(self.key + b"2"), size, 77)[windows] >> U(32)).astype(np.uint32)


def _by_segment(segment: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(segment, kind="stable")
    names, starts = np.unique(segment[order], return_index=True)
    return zip(names.tolist(), np.split(order, starts[1:]))


ASKED = "segment long, kind int, anchors binary, counts binary, refs binary, places binary"


def _ask(anchor: np.ndarray, ref: np.ndarray, pos: np.ndarray, segments: int) -> Iterator[tuple]:
    """Rows of ASKED: 0 counts of anchors, 1 questions for those seen once, 2 places of the others, which need no answer."""
    kinds, inverse, counts = np.unique(anchor, return_inverse=True, return_counts=True)
    where = (mix(kinds, 21) % U(segments)).astype(np.int64)
    for s, i in _by_segment(where):
        yield s, 0, _short(kinds[i]), counts[i].astype(np.uint32).tobytes(), None, None
    once = counts[inverse] == 1
    a, r, p = anchor[once], ref[once], pos[once].astype(np.uint32)
    for s, i in _by_segment(where[inverse[once]]):
        yield s, 1, _short(a[i]), None, _short(r[i]), p[i].tobytes()
    r, p = ref[~once], pos[~once].astype(np.uint32)
    if len(r):
        order = np.lexsort((p, r))
        r, p = r[order], p[order]
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] != r[:-1]) | (p[1:] != p[:-1])
        yield int(mix(r[:1], 22)[0] % U(segments)), 2, None, None, _short(r[new]), p[new].tobytes()


class Segment:
    """Two rows of counts, and the anchors whose estimate reaches hot_from."""

    def __init__(self, bits: int, hot_from: int):
        self.bits, self.hot_from, self.hot = bits, hot_from, np.zeros(0, U)
        self.counts = [np.zeros(1 << bits, np.uint32) for _ in range(2)]

    def estimate(self, anchors: np.ndarray) -> np.ndarray:
        return np.minimum(*(c[mix(anchors, 11 + i) >> U(64 - self.bits)] for i, c in enumerate(self.counts)))

    def add(self, anchors: np.ndarray, counts: np.ndarray) -> None:
        for i, c in enumerate(self.counts):
            np.add.at(c, mix(anchors, 11 + i) >> U(64 - self.bits), counts)
        high = anchors[self.estimate(anchors) >= self.hot_from]
        if len(high):
            self.hot = np.union1d(self.hot, high)


def segments_of(spark: SparkSession, total: int, size: int) -> int:
    return max(partitions(spark), int(total // size))


def estimated(docs: DataFrame, total: int, key: bytes, size: int = WINDOW, anchor: int = ANCHOR, bits: int | None = None, flush: int = FLUSH_ANCHORS) -> DataFrame:
    """ref (48 bits) and places (first windows of runs) of anchors estimated to occur twice; rows without ref name hot anchors in places.

    docs: ref, text. An estimate may be too high, never too low.
    """
    spark = docs.sparkSession
    segments = segments_of(spark, total, SEGMENT_BYTES)
    bits = bits or min(25, max(10, int(total // segments // 33).bit_length()))  # about two cells an anchor
    hot_from = max(1000, GROUP_BYTES // 6 // (4 * (size - anchor + 1)))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in ASKED.split(", ")]
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 4]

        def out() -> pa.RecordBatch:
            rows = list(_ask(*(np.concatenate(x) for x in zip(*held)), segments))
            return pa.record_batch({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})

        held, n = [], 0
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                found = Anchored(chunk.column("text"), size, anchor, key)
                held.append((found.anchor & U(SHORT), chunk.column("ref").to_numpy().view(U)[found.doc] & U(SHORT), found.pos))
                n += len(found.anchor)
                if n > flush:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(ref: np.ndarray, pos: np.ndarray) -> pa.RecordBatch:
            order = np.lexsort((pos, ref))
            ref, pos = ref[order].astype(np.int64), pos[order].astype(np.uint32)
            starts = np.flatnonzero(np.append(True, ref[1:] != ref[:-1]))
            ends = pa.array(4 * np.append(starts, len(ref)), pa.int32())
            return pa.record_batch({"ref": pa.array(ref[starts]), "places": pa.Array.from_buffers(pa.binary(), len(starts), [None, ends.buffers()[1], pa.py_buffer(pos.tobytes())])})

        def hot_ones() -> Iterator[pa.RecordBatch]:
            if segment is not None and len(segment.hot):
                yield pa.record_batch({"ref": pa.array([None], pa.int64()), "places": pa.array([segment.hot.tobytes()], pa.binary())})

        at, segment = None, None
        for batch in batches:
            for s, kind, *parts in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if s != at:
                    yield from hot_ones()
                    at, segment = s, Segment(bits, hot_from)
                anchors, refs = (None if x is None else _long(x) for x in parts[::2])
                counts, places = (None if x is None else np.frombuffer(x, np.uint32) for x in parts[1::2])
                if kind == 0:
                    segment.add(anchors, counts)
                else:
                    yes = segment.estimate(anchors) > 1 if kind == 1 else np.ones(len(refs), bool)
                    if yes.any():
                        yield told(refs[yes], places[yes])
        yield from hot_ones()

    asked = docs.select("ref", "text").mapInArrow(ask, ASKED)
    asked = asked.repartition(partitions(spark), "segment").sortWithinPartitions("segment", "kind")
    return shared(asked.mapInArrow(answer, "ref long, places binary"))


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs, given where a new one must begin; none longer than SPAN - 1."""
    n = len(breaks)
    starts = np.flatnonzero(breaks)
    lengths = np.diff(np.append(starts, n))
    if len(lengths) and lengths.max() >= SPAN:
        breaks = breaks.copy()
        breaks[:: SPAN - 1] = True
        return _runs(breaks)
    return starts, lengths


def _breaks(ref: np.ndarray, pos: np.ndarray) -> np.ndarray:
    out = np.ones(len(ref), bool)
    out[1:] = (ref[1:] != ref[:-1]) | (pos[1:] != pos[:-1] + 1)
    return out


PACKED = "segment long, run_key binary, run_pos binary, run_len binary, hash binary, hash2 binary, twice binary, done_key binary, done_code binary"


def _pack(anchor: np.ndarray, hashes: np.ndarray, more: np.ndarray, doc: np.ndarray, pos: np.ndarray, keys: np.ndarray, segments: int, hot: np.ndarray) -> Iterator[tuple]:
    """Rows of PACKED of one flush: windows to compare, and the places of windows already known to repeat."""
    order = np.lexsort((more, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (more[order][1:] != more[order][:-1])
    counts = np.diff(np.append(np.flatnonzero(new), len(order)))
    twice = np.empty(len(order), bool)
    twice[order] = (counts > 1)[np.cumsum(new) - 1]
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    done_starts, done_lengths = _runs(_breaks(doc[twice], pos[twice]))
    done_doc, done_code = doc[twice][done_starts], pos[twice][done_starts].astype(np.int64) * SPAN + done_lengths
    anchor, hashes, more, doc, pos, twice = (x[first] for x in (anchor, hashes, more, doc, pos, twice))
    breaks = _breaks(doc, pos)
    breaks[1:] |= anchor[1:] != anchor[:-1]
    alone = np.isin(anchor & U(SHORT), hot) if len(hot) else np.zeros(len(anchor), bool)
    starts, lengths = _runs(breaks | alone)
    dealt = np.where(alone[starts], mix(hashes[starts], 24), anchor[starts])
    segment = (mix(dealt, 21) % U(segments)).astype(np.int64)
    done_segment = (mix(keys["ref"][done_doc].view(U), 22) % U(segments)).astype(np.int64)
    runs, done = dict(_by_segment(segment)), dict(_by_segment(done_segment))
    nothing = np.zeros(0, np.int64)
    for s in runs.keys() | done.keys():
        r, d = runs.get(s, nothing), done.get(s, nothing)
        w = np.repeat(starts[r] - np.concatenate([[0], np.cumsum(lengths[r])[:-1]]), lengths[r]) + np.arange(lengths[r].sum()) if len(r) else nothing
        yield (
            s, keys[doc[starts[r]]].tobytes(), pos[starts[r]].astype(np.uint32).tobytes(), lengths[r].astype(np.uint32).tobytes(),
            hashes[w].tobytes(), more[w].tobytes(), np.packbits(twice[w]).tobytes(), keys[done_doc[d]].tobytes(), done_code[d].tobytes(),
        )


def _group(t: pa.Table) -> pa.RecordBatch:
    """Exact grouping of one segment: the spans of windows that repeat, as the row's keys and pos * SPAN + length."""

    def column(name: str, dtype: np.dtype | type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x.as_buffer(), dtype) for x in t.column(name)])

    lengths = column("run_len", np.uint32).astype(np.int64)
    key = np.repeat(column("run_key", KEY), lengths)
    pos = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(column("run_pos", np.uint32).astype(np.int64), lengths)
    hashes, more = column("hash", U), column("hash2", np.uint32)
    twice = np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(h.as_buffer()) // 8).astype(bool) for x, h in zip(t.column("twice"), t.column("hash"))])
    order = np.lexsort((more, hashes))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (more[order][1:] != more[order][:-1])
    starts = np.flatnonzero(new)
    again = np.diff(np.append(starts, len(order))) > 1
    if len(starts):
        again |= np.logical_or.reduceat(twice[order], starts)
    found = np.zeros(len(order), bool)
    found[order] = again[np.cumsum(new) - 1]
    key, pos = key[found], pos[found]
    by = np.lexsort((pos, key["ref2"], key["ref"]))
    key, pos = key[by], pos[by]
    at, n = _runs(_breaks(key, pos))
    key, code = np.concatenate([key[at], column("done_key", KEY)]), np.concatenate([pos[at] * SPAN + n, column("done_code", np.int64)])
    return pa.record_batch({"ref": key["ref"].copy(), "ref2": key["ref2"].copy(), "code": code})


def packed_windows(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR, bits: int | None = None, flush: int = FLUSH_WINDOWS) -> DataFrame:
    """The windows that may repeat, packed and dealt to segments.

    docs: ref, ref2, text. Further columns travel along unread, so that a join of the same docs by the same key finds this shuffle done.
    """
    spark = docs.sparkSession
    anchor = min(anchor, size)
    total = docs.agg(F.sum(byte_length(F.col("text")))).first()[0] or 0
    drawn = secrets.token_bytes(16)
    told = estimated(docs, total, drawn, size, anchor, bits)
    segments = segments_of(spark, total, GROUP_BYTES)
    # Anchors that fill a quarter of a group segment or more: about four times as many as such segments at most.
    hot = [np.frombuffer(r.places, U) for r in told.where("ref IS NULL").select("places").toLocalIterator()]
    sent = spark.sparkContext.broadcast(np.unique(np.concatenate([np.zeros(0, U), *hot])).tobytes())
    marks = told.where("ref IS NOT NULL").groupBy(F.col("ref").alias("of")).agg(F.collect_set("places").alias("marks"))
    marked = docs.join(marks, docs.ref.bitwiseAND(F.lit(SHORT)) == marks.of).select(*docs.columns, "marks")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.frombuffer(sent.value, U)
        names = [c.split()[0] for c in PACKED.split(", ")]
        held: list[tuple] = []
        keys: list[np.ndarray] = []
        n = docs_held = 0

        def out() -> pa.RecordBatch:
            rows = list(_pack(*(np.concatenate(x) for x in zip(*held)), np.concatenate(keys), segments, hot))
            return pa.record_batch({k: pa.array([r[i] for r in rows], pa.int64() if k == "segment" else pa.binary()) for i, k in enumerate(names)})

        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                found = Anchored(chunk.column("text"), size, anchor, drawn)
                marks = [np.frombuffer(b"".join(m), np.uint32) for m in chunk.column("marks").to_pylist()]
                asked = (np.repeat(np.arange(len(marks)), [len(m) for m in marks]) << 32) | np.concatenate(marks)
                maybe = np.isin((found.doc << 32) | found.pos, asked)
                which = np.repeat(maybe, found.lengths)
                window = found.window[which]
                if not len(window):
                    continue
                doc = np.repeat(found.doc[maybe], found.lengths[maybe])
                held.append((np.repeat(found.anchor[maybe], found.lengths[maybe]), *found.hashes(size, window), doc + docs_held, window - found.words.at[doc]))
                key = np.empty(chunk.num_rows, KEY)
                key["ref"], key["ref2"] = chunk.column("ref").to_numpy(), chunk.column("ref2").to_numpy()
                keys.append(key)
                docs_held += len(key)
                n += len(window)
                if n > flush:
                    yield out()
                    held, keys, n, docs_held = [], [], 0, 0
        if n:
            yield out()

    return marked.mapInArrow(emit, PACKED)


def repeated_spans(docs: DataFrame, size: int = WINDOW, anchor: int = ANCHOR, bits: int | None = None, flush: int = FLUSH_WINDOWS) -> DataFrame:
    """of (48 bits of the rows' first content key) and spans (ref, ref2, code: first window * SPAN + windows) of rows with repeated windows."""

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in runs_of(batches, "segment"):
            yield _group(t)

    packed = packed_windows(docs, size, anchor, bits, flush)
    packed = packed.repartition(partitions(docs.sparkSession), "segment").sortWithinPartitions("segment")
    found = packed.mapInArrow(group, "ref long, ref2 long, code long")
    return found.groupBy(F.col("ref").bitwiseAND(F.lit(SHORT)).alias("of")).agg(F.collect_set(F.struct("ref", "ref2", "code")).alias("spans"))


def removed_words(n: int, spans: np.ndarray, size: int) -> np.ndarray:
    """Which of n words the windows of spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans // SPAN, 1)
    np.add.at(edge, np.minimum(spans // SPAN + spans % SPAN + size - 1, n), -1)
    return np.cumsum(edge[:-1]) > 0


def cut_repeats(docs: DataFrame, finish: Callable[[list[bytes], np.ndarray | None], tuple], schema: str, carry: list[str] = ["doc_id"], size: int = WINDOW, **options) -> DataFrame:  # noqa: B006
    """row (a struct of the columns carry of docs) and made (a struct of those of schema) for each row of docs.

    Judges the windows of docs and hands each row's text, words and removal
    mask (None: nothing repeats) to finish. Null texts have no words. Rows
    alike in id and text count as two places. An empty table gives no rows.
    Columns of docs may have any names.
    """
    ref, ref2 = row_keys(F.col("doc_id"), F.col("text"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "text", ref.alias("ref"), ref2.alias("ref2"))
    spans = repeated_spans(keyed, size, **options)
    joined = keyed.join(spans, keyed.ref.bitwiseAND(F.lit(SHORT)) == spans.of, "left")
    own = F.expr("transform(filter(spans, s -> s.ref = ref AND s.ref2 = ref2), s -> s.code)")
    joined = joined.select("row", "text", F.when(F.size(own) > 0, own).alias("spans"))
    made = docs.sparkSession.createDataFrame([], schema).schema
    names, types = made.fieldNames(), to_arrow_schema(made).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("text"), batch.column("spans")):
                words = (text.as_py() or "").encode().split()
                mask = removed_words(len(words), spans.values.to_numpy(zero_copy_only=False), size) if spans.is_valid else None
                rows.append(finish(text.as_py(), words, mask))
            out = pa.StructArray.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)
            yield pa.record_batch({"row": batch.column("row"), "made": out})

    return joined.mapInArrow(run, StructType([StructField("row", keyed.schema["row"].dataType), StructField("made", made)]))


def digests(text: str | None, words: list[bytes], mask: np.ndarray | None) -> tuple:
    kept = words if mask is None else [w for w, gone in zip(words, mask.tolist()) if not gone]
    return len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()


def repeat_digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row of docs.

    Null and empty texts have no words. Repeated rows repeat each other. An
    empty table gives no rows. A very long text comes alone and whole, and its
    windows leave in flushes. Other columns, of any names, are not read.
    """
    return cut_repeats(docs, digests, "n_words long, n_removed long, kept_sha256 string", **options).select("row.doc_id", "made.*")


def remove_repeats(docs: DataFrame, size: int = WINDOW, **options) -> DataFrame:
    """docs with every word gone that a repeated window covers.

    A text in which nothing repeats stays as it is; of others the kept words
    are joined by one space. Texts of which nothing is left go. n_chars, if
    there, follows the text. Null texts stay null. Repeated rows repeat each
    other. An empty table gives no rows. Columns may have any names. Very long
    texts are cut whole.
    """

    def finish(text: str | None, words: list[bytes], mask: np.ndarray | None) -> tuple:
        return (text if mask is None else b" ".join(w for w, gone in zip(words, mask.tolist()) if not gone).decode(), mask is not None and bool(mask.all()))

    carry = [c for c in docs.columns if c != "text"]
    cut = cut_repeats(docs, finish, "kept string, emptied boolean", carry, size, **options).where("NOT made.emptied")
    new = {"text": F.col("made.kept"), "n_chars": F.when(F.col("made.kept").isNull(), F.col("row.n_chars")).otherwise(F.length("made.kept").cast("long")) if "n_chars" in carry else None}
    return cut.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
