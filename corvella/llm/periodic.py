"""Periodic runs of words by Crochemore's partition refinement.

Positions of a text are classed by the factor of l words that starts there. The
classes of length l + 1 come from those of length l by splitting: two positions
stay together if the positions after them do. Only classes that were split off
as smaller parts are looked at for that (the largest part of a split class may
be left out, since all its positions agree on where they came from), so a
position is touched log(n) times at most.

Neighbours of a class that lie l apart while the class is one of length l mark
a square: a primitive root of l words, twice. Squares of one root length at
consecutive places make one run. A pair of neighbours is looked at once, when
it is parted: between the lengths at which it arose and was parted, its
distance was reached or not.

All texts of a batch are refined together as NumPy arrays, each with an end
mark of its own, so that a length costs a few array operations, not a text.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .cluster import text_chunks

LEAST_RUN = 12  # words
AT_ONCE = 4 << 20  # bytes of text that are refined together; a longer text comes alone
FEW = 48  # positions up to which a loop is quicker than array operations


class Classes:
    """Classes of positions, each with its members and its members' neighbours.

    of: the class of a position. before, after: its neighbours in the class, or
    -1. since: the length from which on `after` has been its neighbour. Members
    of class c lie in pool[first[c] : first[c] + room[c]], in order, beside some
    that left since; held counts those that are left.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.order = order = np.argsort(symbols, kind="stable")
        new = np.ones(n, bool)
        new[1:] = symbols[order][1:] != symbols[order][:-1]
        starts = np.flatnonzero(new)
        self.of = np.empty(n, np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.pool, self.used = order.copy(), n
        self.first, self.held = starts, np.diff(np.append(starts, n))
        self.room, self.classes = self.held.copy(), len(starts)
        self.before, self.after, self.since = np.full(n, -1), np.full(n, -1), np.ones(n, np.int64)
        inner = ~new[1:]
        self.after[order[:-1][inner]] = order[1:][inner]
        self.before[order[1:][inner]] = order[:-1][inner]
        self.squares: list[tuple[np.ndarray, np.ndarray]] = []

    def _told(self, at: np.ndarray, length: int) -> None:
        """Notes the squares of pairs (position, after) that end with this length."""
        gap = self.after[at] - at
        found = (self.after[at] >= 0) & (self.since[at] <= gap) & (gap <= length)
        if found.any():
            self.squares.append((at[found], gap[found]))

    def _grow(self, name: str, size: int) -> None:
        held = getattr(self, name)
        if size > len(held):
            setattr(self, name, np.concatenate([held, np.zeros(max(size - len(held), len(held)), np.int64)]))

    def _members(self, classes: np.ndarray) -> np.ndarray:
        """Positions of these classes."""
        room = self.room[classes]
        total = int(room.sum())
        at = np.repeat(self.first[classes] - np.concatenate([[0], np.cumsum(room)[:-1]]), room) + np.arange(total)
        found = self.pool[at]
        return found[self.of[found] == np.repeat(classes, room)]

    def _store(self, classes: np.ndarray, sizes: np.ndarray, members: np.ndarray) -> None:
        """Gives the classes new places in the pool; members come class by class."""
        if self.used + len(members) > 4 * len(self.of):
            live = np.flatnonzero(self.held[: self.classes] > 1)
            live = live[~np.isin(live, classes)]
            kept = self._members(live)
            self.room[live] = self.held[live]
            self.first[live] = np.concatenate([[0], np.cumsum(self.held[live])[:-1]]) if len(live) else 0
            self.pool[: len(kept)], self.used = kept, len(kept)
        self._grow("pool", self.used + len(members))
        self.pool[self.used : self.used + len(members)] = members
        self.first[classes] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.room[classes] = sizes
        self.used += len(members)

    def refine(self, small: np.ndarray, length: int) -> np.ndarray:
        """From classes of `length` to those of length + 1. small: positions of the smaller parts of the last step. Gives those of this step."""
        touched = small[small > 0] - 1
        touched = touched[self.held[self.of[touched]] > 1]
        if not len(touched):
            return touched
        old, then = self.of[touched], self.of[touched + 1]
        by = np.lexsort((touched, then, old))
        touched, old, then = touched[by], old[by], then[by]
        fresh = np.ones(len(touched), bool)
        fresh[1:] = (old[1:] != old[:-1]) | (then[1:] != then[:-1])
        heads = np.flatnonzero(fresh)
        sizes, parent = np.diff(np.append(heads, len(touched))), old[heads]
        apart = np.ones(len(heads), bool)
        apart[1:] = parent[1:] != parent[:-1]
        parents = np.flatnonzero(apart)
        left = self.held[parent[parents]] - np.add.reduceat(sizes, parents)  # members that stay in the old class
        # A class that goes on as one part is not split.
        whole = (left == 0) & (np.diff(np.append(parents, len(heads))) == 1)
        if whole.any():
            gone = np.repeat(np.repeat(whole, np.diff(np.append(parents, len(heads)))), sizes)
            if gone.all():
                return touched[:0]
            keep = ~gone
            touched, fresh = touched[keep], fresh[keep]
            heads_kept = ~np.repeat(whole, np.diff(np.append(parents, len(heads))))
            sizes, parent, apart = sizes[heads_kept], parent[heads_kept], apart[heads_kept]
            heads, parents, left = np.flatnonzero(fresh), np.flatnonzero(apart), left[~whole]
        many = np.diff(np.append(parents, len(heads)))
        # Those that leave are cut out of their old class's list, stretch by stretch.
        cut = np.ones(len(touched), bool)
        by_place = np.lexsort((touched, self.of[touched]))
        inorder = touched[by_place]
        cut[1:] = self.after[inorder[:-1]] != inorder[1:]
        first = np.flatnonzero(cut)
        ends = np.append(first[1:], len(inorder)) - 1
        prior, next_ = self.before[inorder[first]], self.after[inorder[ends]]
        has = prior >= 0
        self._told(prior[has], length)
        self.after[prior[has]], self.since[prior[has]] = next_[has], length + 1
        has_next = next_ >= 0
        self.before[next_[has_next]] = prior[has_next]
        # Their new lists; a pair that stays together keeps its age.
        after, before = np.full(len(touched), -1), np.full(len(touched), -1)
        inner = ~fresh[1:]
        after[:-1][inner], before[1:][inner] = touched[1:][inner], touched[:-1][inner]
        parted = after != self.after[touched]
        self._told(touched[parted], length)
        self.after[touched], self.before[touched] = after, before
        self.since[touched[parted]] = length + 1
        # Classes: a new one for each part.
        made = self.classes + np.arange(len(heads))
        self.classes += len(heads)
        for name in ("first", "held", "room"):
            self._grow(name, self.classes)
        self.of[touched] = np.repeat(made, sizes)
        self.held[made], self.held[parent[parents]] = sizes, left
        self._store(made, sizes, touched)
        # Of each split class all parts but the largest are small.
        part = np.repeat(np.arange(len(parents)), many)
        largest = np.maximum.reduceat(sizes, parents)
        rest_first = left >= largest
        top = (sizes == largest[part]) & ~rest_first[part]
        top[1:] &= ~((np.cumsum(top)[:-1] - (np.cumsum(top) - top)[parents][part[1:]]) > 0)  # one of equals
        small = touched[np.repeat(~top, sizes)]
        rest = parent[parents][(left > 0) & ~rest_first]
        if len(rest):
            stay = self._members(rest)
            self._store(rest, self.held[rest], stay)
            small = np.concatenate([small, stay])
        # Classes that mostly hold positions that left are written anew.
        thin = parent[parents]
        thin = thin[(self.room[thin] > 2 * self.held[thin]) & (self.held[thin] > 1)]
        if len(thin):
            self._store(thin, self.held[thin], self._members(thin))
        return small

    def refine_few(self, small: list[int], length: int) -> list[int]:
        """refine for a handful of positions, as a loop: most lengths touch only the ends of the longest repeats."""
        of, before, after, since, held = self.of, self.before, self.after, self.since, self.held
        parts: dict[int, dict[int, list[int]]] = {}
        for t in sorted(small):
            if t and held[c := int(of[t - 1])] > 1:
                parts.setdefault(c, {}).setdefault(int(of[t]), []).append(t - 1)

        def part_with(x: int, y: int) -> None:
            """x gets y as its next neighbour."""
            if (a := int(after[x])) != y:
                if 0 <= a and since[x] <= a - x <= length:
                    self.squares.append((np.array([x]), np.array([a - x])))
                after[x], since[x] = y, length + 1

        small = []
        for old, leaving in parts.items():
            groups = list(leaving.values())
            left = int(held[old]) - sum(map(len, groups))
            if not left and len(groups) == 1:
                continue
            gone = {t for g in groups for t in g}
            for t in gone:
                if (b := int(before[t])) not in gone:
                    a = int(after[t])
                    while a in gone:
                        a = int(after[a])
                    if b >= 0:
                        part_with(b, a)
                    if a >= 0:
                        before[a] = b
            for name in ("first", "held", "room"):
                self._grow(name, self.classes + len(groups))
            held = self.held
            held[old] = left
            biggest = max(groups, key=len)
            for g in groups:
                for b, t, a in zip([-1, *g], g, [*g[1:], -1]):
                    before[t] = b
                    part_with(t, a)
                    of[t] = self.classes
                held[self.classes] = len(g)
                self._store(np.array([self.classes]), np.array([len(g)]), np.array(g))
                self.classes += 1
                if g is not biggest or left >= len(biggest):
                    small += g
            if 0 < left < len(biggest):
                stay = self._members(np.array([old]))
                self._store(np.array([old]), held[[old]], stay)
                small += stay.tolist()
            elif left > 1 and self.room[old] > 2 * left:
                self._store(np.array([old]), held[[old]], self._members(np.array([old])))
        return small

    def all_squares(self) -> tuple[np.ndarray, np.ndarray]:
        """(position, root length) of every primitively rooted square."""
        biggest = int(np.argmax(self.held[: self.classes])) if self.classes else 0
        small, length = np.flatnonzero(self.of != biggest), 1
        while len(small):
            small = self.refine(np.asarray(small), length) if len(small) > FEW else self.refine_few([int(x) for x in small], length)
            length += 1
        self._told(np.arange(len(self.of)), len(self.of))
        if not self.squares:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*self.squares))


def runs_of_squares(at: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Rows (start, length, period), by start and period, from squares."""
    by = np.lexsort((at, root))
    at, root = at[by], root[by]
    new = np.ones(len(at), bool)
    new[1:] = (root[1:] != root[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    squares = np.diff(np.append(first, len(at)))
    out = np.stack([at[first], squares - 1 + 2 * root[first], root[first]], 1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def runs(texts: list[list], least: int = LEAST_RUN) -> list[np.ndarray]:
    """For each list of words its runs of `least` words or more: rows (start, length, period) by start and period."""
    names: dict = {}
    symbols = np.fromiter((names.setdefault(w, len(names)) for words in texts for w in [*words, None]), np.int64)
    sizes = np.array([len(words) + 1 for words in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    # Symbols of different texts differ, and so do their end marks.
    symbols = symbols * len(texts) + np.repeat(np.arange(len(texts)), sizes)
    found = runs_of_squares(*Classes(symbols).all_squares()) if len(symbols) else np.zeros((0, 3), np.int64)
    found = found[found[:, 1] >= least]
    text = np.searchsorted(offsets, found[:, 0], "right") - 1
    found[:, 0] -= offsets[text]
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [found[a:b] for a, b in zip(cuts, cuts[1:])]


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Which of n words no run repeats after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, found[:, 0] + found[:, 2], 1)
    np.add.at(edge, found[:, 0] + found[:, 1], -1)
    return np.cumsum(edge[:-1]) <= 0


def with_period(words: list, doc_id: int | None) -> list:
    """The words, with a periodic tail in a tenth of the ids, as the query's contract lays down."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(words: list[bytes], found: np.ndarray) -> tuple:
    """n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256."""
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
    kept = words if not len(found) else [w for w, k in zip(words, kept_words(len(words), found).tolist()) if k]
    best = min(found.tolist(), key=lambda r: (-r[1], r[0], r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *longest, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


DIGEST = "doc_id {id}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from text_chunks(batch, "text", most)


def run_digests(docs: DataFrame, tails: bool = False, least: int = LEAST_RUN, at_once: int = AT_ONCE) -> DataFrame:
    """doc_id and DIGEST's columns of every row of docs. tails: give a tenth of the texts periodic tails first.

    Null and empty texts have no words and no runs. Null ids get no tail.
    Repeated rows give repeated results. Very long texts are taken whole: some
    150 bytes and, for each length up to the longest repeat, one step a word
    list. An empty table gives no rows. Other columns, whatever their names,
    are not read.
    """
    id_type = docs.schema["doc_id"].dataType
    made = docs.sparkSession.createDataFrame([], DIGEST.format(id=id_type.simpleString())).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, at_once):
            ids = chunk.column("doc_id").to_pylist()
            texts = [(t or b"").split() for t in chunk.column("text").cast(pa.binary()).to_pylist()]
            if tails:
                texts = [with_period(w, i) for w, i in zip(texts, ids)]
            rows = [digest(w, r) for w, r in zip(texts, runs(texts, least))]
            columns = list(zip(*rows))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.record_batch([chunk.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, kinds)]], names=made.fieldNames())

    return docs.select("doc_id", "text").mapInArrow(run, made)


def collapse_runs(docs: DataFrame, least: int = LEAST_RUN, at_once: int = AT_ONCE) -> DataFrame:
    """docs with each run cut down to its first period.

    Texts without runs stay as they are; of others the kept words are joined by
    one space. n_chars, if there, follows the text. Nulls, repeated rows, very
    long texts and empty tables: as run_digests. Columns may have any names.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StringType, StructField, StructType

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    told = docs.select(row, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, at_once):
            raw = chunk.column("text").cast(pa.binary()).to_pylist()
            texts = [(t or b"").split() for t in raw]
            found = runs(texts, least)
            out = [t if not len(r) else b" ".join(w for w, k in zip(words, kept_words(len(words), r).tolist()) if k) for t, words, r in zip(raw, texts, found)]
            yield pa.record_batch([chunk.column("row"), pa.array(out, pa.binary()).cast(pa.string())], names=["row", "text"])

    cut = told.mapInArrow(run, StructType([told.schema["row"], StructField("text", StringType())]))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("text").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast("long"))
    return cut.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns])
