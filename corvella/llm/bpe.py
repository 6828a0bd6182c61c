"""BPE encoding and decoding: speculate and verify.

For every new word of a batch a greedy longest match proposes tokens. A
proposal is the exact BPE result if and only if each adjacent pair of its
tokens is compatible, that is, if undoing the pair's merges from the last to
the first never meets a merge across the border that would have come earlier.
All pairs of all new words are tested at once with NumPy; only words with a
failing pair go through exact merging.

Vocabularies are files in the JSON format of the public tokenizers library
with word-end suffixes: NFC, white space folded, lower case, a split pattern,
byte symbols. The file is read on the driver and broadcast; a vocabulary's
size is fixed.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .cluster import text_chunks

MOST_CACHED_WORDS = 150_000  # in each of two generations, in each worker
LONG_WORD = 48  # bytes from which on a word is merged alone
NO_MERGE = 1 << 40
_NO_SPACE = regex.compile(r"\S+")
_CONTROL = re.compile("[\x1c-\x1f]")


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte: itself where it prints, else 256, 257, ..."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in prints}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(prints))
    return table


# Ranges of code points that the library, whose tables are of Unicode 16, takes for signs, while newer tables have them as letters and numbers.
SIGNS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF "
    "2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
).split()
# Ranges of capitals that only the library lower-cases, and the small letter of the first.
CAPITALS = (
    "1C89 1C8A", "A7CB 0264", "A7CC A7CD", "A7CE A7CF", "A7D2 A7D3", "A7D4 A7D5", "A7DA A7DB", "A7DC 019B", "10D50-10D65 10D70", "16EA0-16EB8 16EBB",
)


def _range(written: str) -> range:
    first, _, last = written.partition("-")
    return range(int(first, 16), int(last or first, 16) + 1)


_AS_SIGN = {c: "!" for r in SIGNS for c in _range(r)}
_NEW_SIGN = re.compile("[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in SIGNS) + "]")
_SMALL = {c: int(b, 16) + i for a, b in (p.split() for p in CAPITALS) for i, c in enumerate(_range(a))}
_PERHAPS_NEW = re.compile("[\u0558-\U0010ffff]")  # one range is tested fast; most texts go no further
_NEW_CAPITAL = re.compile("[" + "".join(map(chr, _SMALL)) + "]")


class HashTable:
    """Values of 64-bit keys (not negative), looked up many at a time; -1 for unknown keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size + 64, -1, np.int64), np.full(size + 64, -1, np.int64)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[slot[todo]] < 0
            self.keys[slot[todo[free]]] = keys[todo[free]]  # of several the last one stays
            done = self.keys[slot[todo]] == keys[todo]
            self.values[slot[todo[done]]] = values[todo[done]]
            todo = todo[~done]
            slot[todo] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        found = held == keys
        out = np.where(found, self.values[slot], -1)
        todo = np.flatnonzero(~found & (held >= 0))
        slot = slot[todo]
        while len(todo):
            slot += 1
            held = self.keys[slot]
            found = held == keys[todo]
            out[todo[found]] = self.values[slot[found]]
            go = ~found & (held >= 0)
            todo, slot = todo[go], slot[go]
        return out


class Bpe:
    """Tables of one vocabulary. Words are arrays of byte symbols 0 .. 255, a word's last byte plus 256."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.token_texts = pa.array([self.tokens.get(i, "") for i in range(max(self.tokens) + 1)], pa.string())
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.whole_letters = r"|[\p{L}]+|" in split["pattern"]["Regex"]  # then letters alone are one piece
        self.n = n = max(vocab.values()) + 1
        self.rank, self.left, self.right = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        keys, self.merged = np.empty(len(model["merges"]), np.int64), np.empty(len(model["merges"]), np.int64)
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            keys[r], self.merged[r] = i * n + j, k
            if self.rank[k] < 0:
                self.rank[k], self.left[k], self.right[k] = r, i, j
        self.merges = HashTable(keys, np.arange(len(keys)))
        self.base = np.array([vocab[c + end] for end in ("", suffix) for c in (byte_symbols()[b] for b in range(256))], np.int64)
        self._grow_trie()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _grow_trie(self) -> None:
        """A trie of the tokens that BPE gives for their own symbols."""
        made = np.flatnonzero(self.rank >= 0)
        sound = np.ones(self.n, bool)
        sound[made] = self.compatible(self.left[made], self.right[made], self.rank[made])
        spelled = {t: (b,) for b, t in enumerate(self.base.tolist())}
        edges: dict[int, int] = {}
        ends = [-1]

        def add(token: int) -> None:
            node = 0
            for symbol in spelled[token]:
                key = node * 512 + symbol
                if key not in edges:
                    edges[key] = len(ends)
                    ends.append(-1)
                node = edges[key]
            ends[node] = token

        for token in self.base.tolist():
            add(token)
        for i in made[np.argsort(self.rank[made])].tolist():
            a, b = int(self.left[i]), int(self.right[i])
            spelled[i] = spelled[a] + spelled[b]
            sound[i] &= sound[a] & sound[b]
            if sound[i]:
                add(i)
        self.trie = HashTable(np.array(list(edges), np.int64), np.array(list(edges.values()), np.int64))
        self.ends = np.array(ends, np.int64)

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        found = self.merges.get(a * self.n + b)
        return np.where(found < 0, NO_MERGE, found)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether BPE of the joined pair gives the pair back. limit: merges from that rank on don't count."""
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        limit = np.full(len(a), NO_MERGE) if limit is None else limit
        while len(live):
            bad = self.pair_rank(a, b) < limit
            good[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, ra, rb = live[go], a[go], b[go], ra[go], rb[go]
            late = ra > rb
            limit = np.where(late, ra, rb + 1)
            a, b = np.where(late, self.right[a], a), np.where(late, b, self.left[b])
        return good

    def propose(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, token) in order: greedy longest matches of the words symbols[at[i] : at[i + 1]]."""
        n = len(symbols)
        end = np.repeat(at[1:], np.diff(at))
        token, size = np.full(n, -1), np.ones(n, np.int64)
        live, node, depth = np.arange(n), np.zeros(n, np.int64), 0
        while len(live):
            node = self.trie.get(node * 512 + symbols[live + depth])
            depth += 1
            go = node >= 0
            live, node = live[go], node[go]
            full = self.ends[node] >= 0
            token[live[full]], size[live[full]] = self.ends[node[full]], depth
            go = live + depth < end[live]
            live, node = live[go], node[go]
        words, tokens = [], []
        word, place = np.flatnonzero(np.diff(at) > 0), at[:-1][np.diff(at) > 0]
        while len(word):
            words.append(word)
            tokens.append(token[place])
            place = place + size[place]
            go = place < at[word + 1]
            word, place = word[go], place[go]
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = np.concatenate(words)
        order = np.argsort(word, kind="stable")
        return word[order], np.concatenate(tokens)[order]

    def merge(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words at once: in each the leftmost pair of lowest rank, until none is left.

        ids: a word's base tokens a row, padded. Gives (row, token) in order.
        """
        rows, width = ids.shape
        ids = np.hstack([ids, np.zeros((rows, 1), np.int64)])
        column = np.arange(width + 1)
        ids[column >= lengths[:, None]] = -1
        after = np.tile(np.minimum(column + 1, width), (rows, 1))
        before = np.tile(column - 1, (rows, 1))
        rank = np.full((rows, width), NO_MERGE)
        r, c = np.nonzero(column[None, :-1] + 1 < lengths[:, None])
        rank[r, c] = self.pair_rank(ids[r, c], ids[r, c + 1])
        live = np.arange(rows)
        while len(live):
            at = rank[live].argmin(axis=1)
            best = rank[live, at]
            go = best < NO_MERGE
            live, at, best = live[go], at[go], best[go]
            gone = after[live, at]
            follows = after[live, gone]
            ids[live, at], ids[live, gone], rank[live, gone % width] = self.merged[best], -1, NO_MERGE
            after[live, at], before[live, follows] = follows, at
            right = ids[live, follows]
            new = np.full(len(live), NO_MERGE)
            some = (follows < width) & (right >= 0)
            new[some] = self.pair_rank(ids[live[some], at[some]], right[some])
            rank[live, at] = new
            left = before[live, at]
            some = left >= 0
            rank[live[some], left[some]] = self.pair_rank(ids[live[some], left[some]], ids[live[some], at[some]])
        row, c = np.nonzero(ids >= 0)
        return row, ids[row, c]

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Token ids of non-empty words, 4 bytes each."""
        data = [w.encode() for w in words]
        at = np.cumsum([0, *map(len, data)])
        symbols = np.frombuffer(b"".join(data), np.uint8).astype(np.int64)
        symbols[at[1:] - 1] += 256
        word, token = self.propose(symbols, at)
        inside = np.flatnonzero(word[1:] == word[:-1])
        failing = np.zeros(len(words), bool)
        failing[word[inside[~self.compatible(token[inside], token[inside + 1])]]] = True
        parts = [(word[~failing[word]], token[~failing[word]])]
        bad = np.flatnonzero(failing)
        lengths = np.diff(at)[bad]
        order = np.argsort(lengths, kind="stable")
        bad, lengths = bad[order], lengths[order]
        short = int(np.searchsorted(lengths, LONG_WORD, "right"))
        for i in range(0, short, 4096):
            some, n = bad[i : min(i + 4096, short)], lengths[i : min(i + 4096, short)]
            place = np.minimum(at[some][:, None] + np.arange(n.max()), len(symbols) - 1)
            row, ids = self.merge(self.base[symbols[place]], n)
            parts.append((some[row], ids))
        for w in bad[short:].tolist():
            ids = self.merge_long(self.base[symbols[at[w] : at[w + 1]]].tolist())
            parts.append((np.full(len(ids), w), np.array(ids, np.int64)))
        word, token = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(word, kind="stable")
        flat = token[order].astype(np.int32).tobytes()
        cuts = (4 * np.searchsorted(word[order], np.arange(len(words) + 1))).tolist()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:])]

    def merge_long(self, ids: list[int]) -> list[int]:
        """Exact merging of a very long word with a heap."""
        size = len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        first = self.pair_rank(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < NO_MERGE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= size or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] < size:
                before[after[i]] = i
            near = [(x, y) for x, y in ((before[i], i), (i, after[i])) if x >= 0 and y < size]
            for (x, y), q in zip(near, self.pair_rank(np.array([ids[x] for x, _ in near]), np.array([ids[y] for _, y in near])).tolist() if near else []):
                if q < NO_MERGE:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [t for t in ids if t >= 0]

    def chunks(self, text: str) -> list[str]:
        """Stretches without white space, in order; special tokens after a blank, so that no stretch (lower case) equals one."""
        parts = self.special_pattern.split(text) if self.special_pattern and "<|" in text else [text]
        if len(parts) == 1:
            return self._stretches(text)
        out: list[str] = []
        for p in parts:
            if p in self.special:
                out.append(" " + p)
            elif p:
                out += self._stretches(p)
        return out

    @staticmethod
    def _stretches(text: str) -> list[str]:
        # Lower case goes by single characters, without the rule for a final sigma.
        text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        if _PERHAPS_NEW.search(text) and _NEW_CAPITAL.search(text):
            text = text.translate(_SMALL)
        # str.split would also cut at four control characters that are no white space.
        return _NO_SPACE.findall(text) if _CONTROL.search(text) else text.split()

    def _pieces(self, chunk: str) -> list[str] | tuple[str]:
        if self.whole_letters and chunk.isalpha():
            return (chunk,)
        if _PERHAPS_NEW.search(chunk) and _NEW_SIGN.search(chunk):
            return [chunk[slice(*m.span())] for m in self.pattern.finditer(chunk.translate(_AS_SIGN))]
        return self.pattern.findall(chunk)

    def _learn(self, chunks: list[str]) -> None:
        """Adds the ids of new chunks. A chunk is one or more pieces of the split pattern."""
        pieces = [self._pieces(c) for c in chunks]
        words = list({p for found in pieces for p in found})
        if not words:
            self.young.update((c, b"") for c in chunks)
            return
        ids = dict(zip(words, self.word_ids(words)))
        self.young.update((c, ids[found[0]] if len(found) == 1 else b"".join([ids[p] for p in found])) for c, found in zip(chunks, pieces))

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts in a row, and where each text's begin."""
        found = [self.chunks(t) for t in texts]
        if len(self.young) > MOST_CACHED_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        young.update({" " + t: np.int32(i).tobytes() for t, i in self.special.items()})
        new = []
        for c in set().union(*found).difference(young):
            if (ids := old.get(c)) is None:
                new.append(c)
            else:
                young[c] = ids
        self._learn(new)
        coded = [b"".join([young[c] for c in chunks]) for chunks in found]
        return np.frombuffer(b"".join(coded), np.int32), np.cumsum([0, *map(len, coded)]) // 4

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, at = self.encode_flat(texts)
        return [ids[a:b].tolist() for a, b in zip(at, at[1:])]

    def decode_lists(self, ids: pa.ListArray) -> pa.Array:
        """As the library does without a decoder: tokens joined by spaces. Null lists give empty texts."""
        texts = pa.ListArray.from_arrays(ids.offsets, self.token_texts.take(ids.values))
        return pc.fill_null(pc.binary_join(texts, " "), "")

    def decode(self, ids: list[int]) -> str:
        return self.decode_lists(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


_loaded: dict[str, Bpe] = {}


def load(text: str) -> Bpe:
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Bpe(text)
    return _loaded[key]


def _vocabulary(docs: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row's whole text.

    Null and empty texts have no ids; repeated rows come back repeated; an
    empty table gives no rows; other columns of docs are ignored.
    """
    sent = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(sent.value)
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                flat, at = bpe.encode_flat([t or "" for t in chunk.column("text").to_pylist()])
                yield pa.record_batch({"doc_id": chunk.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))})

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def encode_and_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded of every row: encode, then decode of its ids, in one pass over the texts.

    Null and empty texts have no ids and decode to the empty text; repeated rows
    come back repeated; an empty table gives no rows; other columns are ignored.
    A very long text comes alone and whole.
    """
    sent = _vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(sent.value)
        for batch in batches:
            for chunk in text_chunks(batch, "text"):
                flat, at = bpe.encode_flat([t or "" for t in chunk.column("text").to_pylist()])
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))
                yield pa.record_batch({"doc_id": chunk.column("doc_id"), "ids": ids, "decoded": bpe.decode_lists(ids)})

    return docs.selectExpr("cast(doc_id as long) AS doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and decoded of every row of ids; null and empty ids give an empty text, repeated rows come back repeated, an empty table gives no rows, long lists are decoded whole, other columns are ignored."""
    sent = _vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                whole = pa.concat_arrays([rows.column("ids")])  # offsets from 0
                yield pa.record_batch({"doc_id": rows.column("doc_id"), "ids": whole, "decoded": bpe.decode_lists(whole)})

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
