"""Words, word hashes and n-gram hashes of whole Arrow batches of texts, without a loop over words.

A word is a run of bytes other than space, tab, LF, VT, FF and CR. Its hash
takes eight bytes at a time, each through a full mix of 64 bits, so words that
are made of the same parts in another order (which agree under a polynomial
modulo 2**64) differ. Words over LONG bytes are hashed by XXH3. Every hash has
a key; two keys give two hashes that are independent of each other.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[65:91] = LOWERED[97:123]
#: Keeps the first k of eight bytes.
KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
LONG, STRIP = 64, 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit values."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def secret() -> int:
    """A key that no text can have been made for; for hashes that never leave one run."""
    return int.from_bytes(os.urandom(8), "little")


class Hasher:
    """Word hashes of texts that stand one behind the other in a byte buffer."""

    def __init__(self, lower: bool = False, space: np.ndarray = SPACE, key: int = 0):
        self.lower, self.space, self.key = lower, space, key
        self.start, self.turn = (mix(np.array([key ^ c], U))[0] for c in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))

    def bounds(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words; no word crosses a cut."""
        gap = self.space[data]
        edge = np.empty(len(data) + 1, bool)
        edge[0] = edge[-1] = True
        np.not_equal(gap[1:], gap[:-1], out=edge[1:-1])
        edge[cuts] = True
        at = np.flatnonzero(edge)
        inside = ~gap[at[:-1]]
        return at[:-1][inside], at[1:][inside]

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """One hash for each word; STRIP words are worked on at a time, which bounds memory beside the result."""
        out = np.empty(len(starts), U)
        for i in range(0, len(starts), STRIP):
            s, e = starts[i : i + STRIP], ends[i : i + STRIP]
            base = int(s[0])
            out[i : i + STRIP] = self._strip(data[base : int(e[-1])], s - base, e - base)
        return out

    def _strip(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        padded = np.zeros(len(data) + 8, np.uint8)
        padded[: len(data)] = LOWERED[data] if self.lower else data
        eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
        size = ends - starts
        out = mix((eight[starts] & KEEP[np.minimum(size, 8)]) + self.start + (size.astype(U) * self.turn))
        at = 8
        live = np.flatnonzero((size > at) & (size <= LONG))
        while len(live):
            part = eight[starts[live] + at] & KEEP[np.minimum(size[live] - at, 8)]
            out[live] = mix((out[live] ^ part) * U(0x9FB21C651E98DF25) + self.turn)
            at += 8
            live = live[size[live] > at]
        for i in np.flatnonzero(size > LONG).tolist():
            out[i] = xxhash.xxh3_64_intdigest(padded[starts[i] : ends[i]].tobytes(), int(self.start))
        return out


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of a batch of texts: byte bounds, hashes and the first word of each text."""

    def __init__(self, texts: pa.Array, hasher: Hasher):
        self.data, self.offsets = buffers(texts)
        self.starts, self.ends = hasher.bounds(self.data, self.offsets[:-1][self.offsets[:-1] < len(self.data)])
        self.hash = hasher.hashes(self.data, self.starts, self.ends)
        self.first = np.searchsorted(self.starts, self.offsets)

    def also(self, hasher: Hasher) -> np.ndarray:
        """The words' hashes under another key."""
        return hasher.hashes(self.data, self.starts, self.ends)

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def grams(words: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Hash of the n words from each place on; n - 1 fewer than words, none if there are fewer than n."""
    if len(words) < n:
        return np.zeros(0, U)
    base, last = U(seed | 1), len(words) - n + 1
    out = words[:last] * base
    for k in range(1, n):
        out += words[k : k + last]
        out *= base
    return mix(out)
