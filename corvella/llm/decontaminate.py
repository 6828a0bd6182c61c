"""Benchmark decontamination: CGK embedding, bit-sampling LSH, exact edit check.

A document leaks an item if some stretch of its words is within
floor((1 - similarity) * n) word edits of the item's n words (lower case,
signs dropped). Items are cut into pieces of PIECE words at most. However a
match's edits are spread, some piece holds no more than its own share, so a
piece is looked for as an item of its own and recall does not fall with length.

Windows as long as a piece are embedded by CGK random walks: a
walk copies the word at its position and then stays or steps on by a random
bit of (step, word), so windows at a small edit distance agree in most steps.
Each table hashes a few sampled steps; windows that share a key with a piece
of their length in any of the tables are candidates, in whose surroundings the
whole item is checked by exact semi-global edit distance.

Windows without any run of words that a match must keep (with e edits some
(n - e) // (e + 1) words in a row survive) can't match and are not embedded.

Documents are never shuffled. Items are broadcast in blocks of bounded size.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import byte_length, text_chunks
from .words import NOT_ALNUM, U, Words, mix, rolling

SIMILARITY = 0.8
WALKS, TABLES, SAMPLES = 8, 8, 3
PIECE = 14  # words; measured recall at the full number of edits is 0.99 or more for pieces up to here
STRETCH = 3  # steps of a walk per word
LONGEST_RUN = 3
BLOCK_BYTES = 16 << 20  # of item texts in one broadcast; a block's tables take about 20 times that in a worker
MOST_AT_ONCE = 1 << 20
_built: dict[str, "Items"] = {}  # the tables of the last block, kept from task to task in a worker


def cgk(windows: np.ndarray, lengths: np.ndarray, walk: int) -> np.ndarray:
    """Embeddings of rows of word hashes (padded with 0): STRETCH * width steps each."""
    n, width = windows.shape
    out = np.zeros((n, STRETCH * width), U)
    at = np.zeros(n, np.int64)
    rows = np.arange(n)
    padded = np.hstack([windows, np.zeros((n, 1), U)])
    for step in range(STRETCH * width):
        word = np.where(at < lengths, padded[rows, np.minimum(at, width)], U(0))
        out[:, step] = word
        at += (mix(word, 1000 * walk + step + 1) & U(1)).astype(np.int64)
    return out


def sampled_keys(windows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """One key a table, (rows, WALKS * TABLES). The sampled steps depend on a window's length only."""
    keys = []
    rows = np.arange(len(windows))[:, None]
    for walk in range(WALKS):
        steps = cgk(windows, lengths, walk)
        rng = np.random.default_rng(walk)
        for table in range(TABLES):
            at = (rng.random(SAMPLES)[None, :] * 2 * lengths[:, None]).astype(np.int64)
            key = mix(lengths.astype(U), 50 + walk * TABLES + table)
            for column in steps[rows, at].T:
                key = mix(key * U(0x9E3779B97F4A7C15) + column)
            keys.append(key)
    return np.stack(keys, axis=1)


@dataclass
class Leak:
    row: int
    item: int
    distance: int
    start: int
    length: int


class Items:
    """The lookup tables of a block of items."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float = SIMILARITY):
        words = Words(pc.utf8_lower(pa.array(texts, pa.large_string())), NOT_ALNUM)
        some = [i for i in range(len(ids)) if words.counts[i]]
        self.ids = [ids[i] for i in some]
        self.words = [words.hash[words.at[i] : words.at[i + 1]] for i in some]
        self.n = np.array([len(w) for w in self.words], np.int64)
        self.edits = np.floor((1 - similarity) * self.n + 1e-9).astype(np.int64)
        cuts = [[n * k // m for k in range(m + 1)] for n in self.n.tolist() for m in [-(-n // PIECE)]]
        self.piece_item = np.repeat(np.arange(len(cuts)), [len(c) - 1 for c in cuts])
        self.piece_at = np.array([a for c in cuts for a in c[:-1]], np.int64)
        self.piece_n = np.array([b - a for c in cuts for a, b in zip(c, c[1:])], np.int64)
        self.piece_edits = np.floor((1 - similarity) * self.piece_n + 1e-9).astype(np.int64)
        pieces = [self.words[i][a : a + n] for i, a, n in zip(self.piece_item.tolist(), self.piece_at.tolist(), self.piece_n.tolist())]
        runs = np.clip((self.piece_n - self.piece_edits) // (self.piece_edits + 1), 1, LONGEST_RUN)
        self.runs: dict[int, tuple[np.ndarray, ...]] = {}
        for size in np.unique(runs).tolist():
            grams = [(i, rolling(pieces[i], size)) for i in np.flatnonzero(runs == size).tolist()]
            gram = np.concatenate([g for _, g in grams])
            piece = np.concatenate([np.full(len(g), i) for i, g in grams])
            offset = np.concatenate([np.arange(len(g)) for _, g in grams])
            order = np.argsort(gram, kind="stable")
            gram, piece, offset = gram[order], piece[order], offset[order]
            bits = np.zeros(1 << 20, bool)
            bits[(gram >> U(44)).astype(np.int64)] = True
            self.runs[size] = gram, piece, offset, bits
        if self.ids:
            keys = sampled_keys(self._padded(pieces), self.piece_n)
            self.keys = [(k[o], o) for k in keys.T for o in [np.argsort(k, kind="stable")]]
        self.masks = [self._mask(w.tolist()) for w in self.words]
        self.spelt = [words.spelt(int(words.at[i]), int(words.at[i + 1])) for i in some]
        self.least = [len(m) - e for m, e in zip(self.masks, self.edits.tolist())]  # an edit takes one of an item's different words at most

    @staticmethod
    def _mask(words: list) -> dict:
        """The places of each word, as bits."""
        mask: dict = {}
        for j, w in enumerate(words):
            mask[w] = mask.get(w, 0) | 1 << j
        return mask

    @staticmethod
    def _padded(parts: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(parts), max(map(len, parts))), U)
        for i, w in enumerate(parts):
            out[i, : len(w)] = w
        return out

    def windows(self, words: Words) -> np.ndarray:
        """Distinct (start, length) of windows around surviving runs, clipped to their documents. A length is that of a piece, so it fits 20 bits."""
        doc_start, doc_end = np.repeat(words.at[:-1], words.counts), np.repeat(words.at[1:], words.counts)
        found = []
        for size, (gram, piece, offset, bits) in self.runs.items():
            seen = rolling(words.hash, size)
            at = np.flatnonzero(bits[(seen >> U(44)).astype(np.int64)] & words.fits(size)[: len(seen)])
            low, high = np.searchsorted(gram, seen[at], "left"), np.searchsorted(gram, seen[at], "right")
            many = high - low
            at, low, many = at[many > 0], low[many > 0], many[many > 0]
            # A run that very many items share is worked off in parts of about MOST_AT_ONCE matches.
            part = np.cumsum(many) // MOST_AT_ONCE
            cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(at) else []
            for i, j in zip(cuts, [*cuts[1:], len(at)]):
                a, m = at[i:j], many[i:j]
                which = np.repeat(low[i:j] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                a = np.repeat(a, m)
                n, edits = self.piece_n[piece[which]], self.piece_edits[piece[which]]
                start = np.clip(a - offset[which], doc_start[a], np.maximum(doc_end[a] - n, doc_start[a]))
                room = doc_end[a] - start
                good = room >= n - edits
                found.append(np.unique((start << 20 | n)[good]))
        packed = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return np.stack([packed >> 20, packed & 0xFFFFF], axis=1)

    def candidates(self, words: Words) -> set[tuple[int, int, int]]:
        """(row, item, start) of windows that share a key with a piece; start: where the item would begin, perhaps before its text."""
        windows = self.windows(words)
        doc_end = np.repeat(words.at[1:], words.counts)
        doc = words.doc()
        out: set[tuple[int, int, int]] = set()
        order = np.argsort(windows[:, 1], kind="stable")  # alike lengths together
        for i in range(0, len(order), 2048):
            start, n = windows[order[i : i + 2048]].T
            width = int(n.max())
            at = np.minimum(start[:, None] + np.arange(width), len(words.hash) - 1)
            inside = (np.arange(width) < n[:, None]) & (start[:, None] + np.arange(width) < doc_end[start][:, None])
            keys = sampled_keys(np.where(inside, words.hash[at], U(0)), n)
            for (known, which), key in zip(self.keys, keys.T):
                low, high = np.searchsorted(known, key, "left"), np.searchsorted(known, key, "right")
                for w in np.flatnonzero(high > low).tolist():
                    found = which[low[w] : high[w]]
                    row, first = int(doc[start[w]]), int(start[w])
                    out.update((row, i, first - a) for i, a in zip(self.piece_item[found].tolist(), self.piece_at[found].tolist()))
        return out

    def best_end(self, item: int, text: list, mask: dict) -> tuple[int, int]:
        """The least edit distance of the item to a stretch of text, and where the first such stretch ends. mask: of the item's words, as text has them."""
        n = int(self.n[item])
        full, top = (1 << n) - 1, 1 << (n - 1)
        pv, mv, score, best, end = full, 0, n, n, 0
        for j, h in enumerate(text):
            eq = mask.get(h, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph, mh = mv | (full & ~(xh | pv)), pv & xh
            score += bool(ph & top) - bool(mh & top)
            ph, mh = ph << 1 & full, mh << 1 & full
            pv, mv = mh | (full & ~(xv | ph)), ph & xv
            if score < best:
                best, end = score, j + 1
        return best, end

    def stretch_start(self, item: int, text: list[bytes], distance: int) -> int:
        """Where the longest stretch begins that ends with text and is at that distance."""
        pattern = self.spelt[item]
        row = list(range(len(pattern) + 1))
        found = len(text)
        for k, h in enumerate(reversed(text), 1):
            last, row = row, [k] + [0] * len(pattern)
            for j, p in enumerate(reversed(pattern), 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != h))
            if row[-1] == distance:
                found = len(text) - k
        return found

    def leaks(self, texts: pa.Array) -> list[Leak]:
        """The best place of each item in each text that leaks it."""
        words = Words(pc.utf8_lower(texts.cast(pa.large_string())), NOT_ALNUM)
        if not self.ids or not len(words.hash):
            return []
        found: dict[tuple[int, int], Leak] = {}
        todo = sorted(self.candidates(words))
        i = 0
        while i < len(todo):
            row, item, start = todo[i]
            n, edits = int(self.n[item]), int(self.edits[item])
            until = start
            while i < len(todo) and todo[i][:2] == (row, item) and todo[i][2] <= until + n:
                until = todo[i][2]
                i += 1
            first, last = int(words.at[row]), int(words.at[row + 1])
            # A window is off by its item's edits at most, and by as many again where its text ends.
            a, b = max(first, start - 2 * edits), min(last, until + n + 2 * edits)
            text = words.hash[a:b].tolist()
            if len(self.masks[item].keys() & text) < self.least[item]:
                continue
            # Hashes that meet can only bring item and text closer, so the words themselves decide.
            distance, end = self.best_end(item, text, self.masks[item])
            if distance <= edits:
                text = words.spelt(a, b)
                distance, end = self.best_end(item, text, self._mask(self.spelt[item]))
            if distance <= edits:
                begin = self.stretch_start(item, text[max(0, end - n - edits) : end], distance) + max(0, end - n - edits)
                leak = Leak(row, self.ids[item], distance, a - first + begin, end - begin)
                old = found.get((row, item))
                if old is None or (distance, leak.start) < (old.distance, old.start):
                    found[row, item] = leak
        return [found[k] for k in sorted(found)]


def _blocks(docs: DataFrame, benchmark: DataFrame, similarity: float, block_bytes: int) -> Iterator[Callable[[], Items]]:
    """Loaders of item blocks. Items are read in blocks of about block_bytes of text, dealt by a hash of the id."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    total = rows.agg(F.sum(byte_length(F.col("text")))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for k in range(blocks):
        got = sorted(((r.item_id, r.text) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toLocalIterator()), key=lambda r: (r[0] is None, r))
        sent, name = docs.sparkSession.sparkContext.broadcast(got), uuid.uuid4().hex

        def load(sent=sent, name=name) -> Items:
            if name not in _built:
                _built.clear()
                _built[name] = Items([i for i, _ in sent.value], [t for _, t in sent.value], similarity)
            return _built[name]

        yield load


LEAKS = "doc_id long, item_id long, item_words long, distance int, similarity double, start long, length long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and item that it leaks, with the best place (start and length in words).

    Null and empty texts and items without words leak nothing; items may repeat
    and each is reported; repeated documents are reported each; empty tables
    give no rows; other columns are ignored. A very long text comes alone and
    is searched whole.
    """
    found = None
    for load in _blocks(docs, benchmark, similarity, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], load=load) -> Iterator[pa.RecordBatch]:
            items = load()
            for batch in batches:
                for chunk in text_chunks(batch, "text"):
                    leaks = items.leaks(chunk.column("text"))
                    ids = chunk.column("doc_id").to_pylist()
                    n = dict(zip(items.ids, items.n.tolist()))
                    yield pa.record_batch({
                        "doc_id": pa.array([ids[x.row] for x in leaks], pa.int64()), "item_id": pa.array([x.item for x in leaks], pa.int64()), "item_words": pa.array([n[x.item] for x in leaks], pa.int64()),
                        "distance": pa.array([x.distance for x in leaks], pa.int32()), "similarity": pa.array([1 - x.distance / n[x.item] for x in leaks], pa.float64()),
                        "start": pa.array([x.start for x in leaks], pa.int64()), "length": pa.array([x.length for x in leaks], pa.int64()),
                    })

        part = docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(run, LEAKS)
        found = part if found is None else found.unionAll(part)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that leak no item, columns, of any names, unchanged; documents are not shuffled.

    Null and empty texts leak nothing and stay; repeated rows stay or go
    together; an empty table or benchmark is fine; very long texts are searched
    whole.
    """
    for load in _blocks(docs, benchmark, similarity, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], load=load) -> Iterator[pa.RecordBatch]:
            items = load()
            for batch in batches:
                for chunk in text_chunks(batch, "text"):
                    keep = np.ones(chunk.num_rows, bool)
                    keep[[x.row for x in items.leaks(chunk.column("text"))]] = False
                    yield chunk.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
