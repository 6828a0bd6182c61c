"""Words of many texts at once, as NumPy arrays over one byte buffer.

Texts arrive as an Arrow column. Words are cut at separator bytes and hashed to
64 bits, so no Python code runs per word. All hashes scramble after each step:
sums of powers would meet on crafted texts.

Without a key the hash is a fixed function, which anyone can invert: good for
features, not for telling words apart. Where equal hashes are to mean equal
words, a key drawn for the run goes into every step, so that nobody can make
words whose hashes meet, and 128 bits under two keys leave chance out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

U = np.uint64
_MASK = (1 << 64) - 1
_LANES = np.array([(1 << (8 * k)) - 1 for k in range(9)], U)  # the first k bytes of 8
_ODD = U(0xA0761D6478BD642F)
LONG_WORD = 1024  # bytes from which on a word is hashed by itself


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


scrambled = mix


def separators(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


SPACE = separators(b" \t\n\x0b\x0c\r")
NOT_ALNUM = separators(bytes(b for b in range(128) if not chr(b).isalnum()))


class Words:
    """Words of a batch of texts.

    at: for document i its words are at[i] : at[i + 1].
    start, end: byte positions in data. hash: one 64-bit value a word.
    Null texts have no words.
    """

    def __init__(self, texts: pa.Array | pa.ChunkedArray, sep: np.ndarray = SPACE, key: bytes = b""):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        n = len(texts)
        offs = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        body = texts.buffers()[2] if n else None
        data = np.frombuffer(body, np.uint8)[offs[0] : offs[-1]] if body is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
        offs = offs - offs[0]
        inside = ~sep[data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        cut = offs[1:-1]
        cut = cut[(cut > 0) & (cut < len(data))]
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        self.data, self.n = data, n
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.at = np.searchsorted(self.start, offs)
        self.counts = np.diff(self.at)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        self._lanes = np.ndarray(len(self.data) + 1, "<u8", buffer=padded, strides=(1,))
        self.hash = self.hashes(key)

    def hashes(self, key: bytes) -> np.ndarray:
        """Scrambled over and over, 8 bytes at a time, from the word's length on. A key adds two secret numbers to each step."""
        size, lanes = self.end - self.start, self._lanes
        plus, times = np.frombuffer(hashlib.blake2b(key, digest_size=16).digest(), U) if key else (U(0), U(1))

        def mix(x: np.ndarray, salt: int) -> np.ndarray:
            return scrambled((x + plus) * (times | U(1)) if key else x, salt)

        out = mix(mix(size.astype(U), 7) ^ (lanes[self.start] & _LANES[np.minimum(size, 8)]), 1)
        live, at = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(live):
            out[live] = mix(out[live] ^ (lanes[self.start[live] + at] & _LANES[np.minimum(size[live] - at, 8)]), 1)
            at += 8
            live = live[size[live] > at]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.start[i] : self.end[i]].tobytes(), digest_size=8, key=key).digest(), "little")
        return out

    def prefix_hash(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of more than size (8 at most) bytes, and the hash of their first size bytes."""
        at = np.flatnonzero(self.end - self.start > size)
        return at, mix(self._lanes[self.start[at]] & _LANES[size], 100 + size)

    def spelt(self, first: int, last: int) -> list[bytes]:
        """The words first : last themselves."""
        data = self.data
        return [data[a:b].tobytes() for a, b in zip(self.start[first:last].tolist(), self.end[first:last].tolist())]

    def doc(self) -> np.ndarray:
        """The document's index, for each word."""
        return np.repeat(np.arange(self.n), self.counts)

    def fits(self, size: int) -> np.ndarray:
        """Whether a window of size words that starts here ends in the same document."""
        return np.arange(len(self.hash)) + size <= np.repeat(self.at[1:], self.counts)


def rolling(hashes: np.ndarray, size: int, salt: int = 3) -> np.ndarray:
    """Hash of each run of size consecutive values (len - size + 1 of them), scrambled at each doubling of its length."""
    if len(hashes) < size:
        return np.zeros(0, U)
    out, width = mix(hashes, salt), 1
    while width < size:
        step = min(width, size - width)
        out = mix(out[:-step] * _ODD + out[step:], salt + width)
        width += step
    return out
