"""Token ids of whole batches of texts, exactly as the library has them.

The pretokens of a batch are found by character classes, side by side, and only
distinct ones are encoded; a worker remembers those of earlier batches. Pretokens
are told apart by two 64-bit hashes under keys that each worker draws for itself,
so no text can be made to collide; where the first agree and the second do not,
the batch goes through the library. This holds for texts of plain characters
(Latin letters without combining marks and common signs) and no special strings.
Others go through the library whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa

from .exchange import found
from .store import worker_cache
from .words import Hasher, secret

SPACE, LETTER, NUMBER, OTHER, RARE = range(5)
TOP = 0x2100
MOST_WORDS = 1_500_000
U = np.uint64


def _classes() -> np.ndarray:
    out = np.full(TOP, RARE, np.uint8)
    for c in [*range(9, 14), *range(32, 127), *range(0xA1, 0x180), *range(0x2010, 0x2028), 0x20AC]:
        kind = unicodedata.category(chr(c))[0]
        if c not in (0xAD, 0x130, 0x149, 0x17F):
            out[c] = LETTER if kind == "L" else NUMBER if kind == "N" else OTHER if kind in "PSM" else RARE
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    return out


def _lower() -> np.ndarray:
    return np.array([ord(chr(c).lower()) if c < 0x180 and len(chr(c).lower()) == 1 else c for c in range(TOP)], np.uint32)


class Memo:
    """Values of varying length of byte strings, made once for each distinct string that a worker meets; forgotten when there are MOST_WORDS."""

    def __init__(self, kind: type):
        self.kind, self.hashers = kind, (Hasher(key=secret()), Hasher(key=secret()))
        self.clear()

    def clear(self) -> None:
        """Ascending hashes with their second ones and rows, and the values of each row."""
        self.keys, self.checks, self.rows = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        self.values, self.starts = np.zeros(1 << 20, self.kind), np.zeros(1 << 18, np.int64)
        self.n_rows = self.n_values = 0

    def of(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, make: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray] | None:
        """Values of the strings data[begin:end], in a row, and the n + 1 bounds. make(which) gives values and sizes of new strings.
        None where second hashes tell apart what the first do not."""
        one, two = (x.hashes(data, begin, end) for x in self.hashers)
        h, first, back = np.unique(one, return_index=True, return_inverse=True)
        if not np.array_equal(two[first][back], two):
            return None
        rows = self._known(h, two[first], first, make)
        if rows is None:
            return None
        rows = rows[back]
        n = self.starts[rows + 1] - self.starts[rows]
        total = np.concatenate([[0], np.cumsum(n)])
        return self.values[np.repeat(self.starts[rows] - total[:-1], n) + np.arange(total[-1])], total

    def _known(self, hashes: np.ndarray, checks: np.ndarray, first: np.ndarray, make) -> np.ndarray | None:
        if self.n_rows + len(hashes) > MOST_WORDS:
            self.clear()
        hit, at = found(hashes, self.keys)
        new = np.flatnonzero(~hit)
        if len(new):
            values, size = make(first[new])
            total = len(values)
            while self.n_values + total > len(self.values):
                self.values = np.concatenate([self.values, np.zeros_like(self.values)])
            while self.n_rows + len(new) + 1 > len(self.starts):
                self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.values[self.n_values : self.n_values + total] = values
            self.starts[self.n_rows + 1 : self.n_rows + 1 + len(new)] = self.n_values + np.cumsum(size)
            spot = np.searchsorted(self.keys, hashes[new])
            self.keys = np.insert(self.keys, spot, hashes[new])
            self.checks = np.insert(self.checks, spot, checks[new])
            self.rows = np.insert(self.rows, spot, self.n_rows + np.arange(len(new)))
            self.n_rows += len(new)
            self.n_values += total
            at = found(hashes, self.keys)[1]
        return self.rows[at] if np.array_equal(self.checks[at], checks) else None


class Encoder:
    """words: pretokens without white space, lower-cased (a `</w>` vocabulary); else the byte-level ones, with their blanks."""

    def __init__(self, path: str, words: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), words
        self.classes, self.lower = _classes(), _lower()
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.memo = Memo(np.uint32)

    @property
    def hashers(self) -> tuple[Hasher, Hasher]:
        return self.memo.hashers

    @staticmethod
    def of(path: str, words: bool) -> Encoder:
        cache = worker_cache()
        if ("encoder", path) not in cache:
            cache["encoder", path] = Encoder(path, words)
        return cache["encoder", path]

    def library(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The strings' ids in a row and the number of each."""
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
        size = np.fromiter(map(len, encoded), np.int64, len(encoded))
        return np.fromiter(chain.from_iterable(encoded), np.uint32, int(size.sum())), size

    def _starts(self, cp: np.ndarray, kind: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Where pretokens begin; white space is a pretoken too."""
        n = len(cp)
        first = np.zeros(n + 1, bool)
        first[firsts] = first[n] = True
        edge = first.copy()
        edge[1:n] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(edge)
        begin, end = at[:-1], at[1:]
        start = edge[:n].copy()
        if self.words:
            start |= kind == NUMBER
        else:
            gap = (kind[begin] == SPACE) & ~first[end]
            last = end[gap] - 1
            start[last] = True
            start[end[gap][cp[last] == 32]] = False
        tick = begin[(cp[begin] == 39) & (end - begin == 1) & start[begin] & ~first[end]]
        for p in tick.tolist():
            a = cp[p + 1]
            b = cp[p + 2] if p + 2 < n and not first[p + 2] else 0
            size = 1 if a in (115, 116, 109, 100) else 2 if (a, b) in ((114, 101), (118, 101), (108, 108)) else 0
            if size:
                start[p + 1] = False
                if p + 1 + size < n:
                    start[p + 1 + size] = True
                if size == 2:
                    start[p + 2] = False
        return start

    def _whole(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same as batch(), by the library alone."""
        ids, size = self.library(strings)
        return ids, np.concatenate([[0], np.cumsum(size)])

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and the n + 1 bounds; null is empty."""
        strings = [x or "" for x in texts.to_pylist()]
        size = np.fromiter(map(len, strings), np.int64, len(strings))
        offsets = np.concatenate([[0], np.cumsum(size)])
        cp = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = np.where(cp < TOP, self.classes[np.minimum(cp, TOP - 1)], RARE)
        rare = np.concatenate([[0], np.cumsum(kind == RARE)])
        whole = np.diff(rare[offsets]) > 0
        for i, x in enumerate(strings):
            if "<|" in x and any(s in x for s in self.specials):
                whole[i] = True
        out: list[np.ndarray] = []
        counts = np.zeros(len(strings), np.int64)
        plain = np.flatnonzero(~whole & (size > 0))
        slots: list[tuple[int, np.ndarray]] = []
        if len(plain):
            if len(plain) < len(strings):
                mask = np.repeat(~whole, size)
                cp, kind = cp[mask], kind[mask]
                bounds = np.concatenate([[0], np.cumsum(np.where(whole, 0, size))])
            else:
                bounds = offsets
            firsts = bounds[plain]
            seen = self.lower[np.minimum(cp, TOP - 1)] if self.words else cp
            begin = np.flatnonzero(self._starts(seen, kind, firsts))
            end = np.append(begin[1:], len(cp))
            if self.words:
                word = kind[begin] != SPACE
                begin, end = begin[word], end[word]
            # All code points are below TOP here, so each takes two bytes.
            short = seen.astype("<u2").view(np.uint8)
            text = seen.astype("<u4").tobytes().decode("utf-32-le")
            known = self.memo.of(short, 2 * begin, 2 * end, lambda new: self.library([text[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)]))
            if known is None:
                return self._whole(strings)
            flat, total = known
            at = total[np.searchsorted(begin, np.append(firsts, len(cp)))]
            counts[plain] = np.diff(at)
            slots = [(0, flat)]
        if whole.any():
            rest = np.flatnonzero(whole)
            ids, n = self.library([strings[i] for i in rest])
            parts = dict(zip(rest.tolist(), np.split(ids, np.cumsum(n)[:-1]), strict=True))
            flat, at = (slots[0][1] if slots else np.zeros(0, np.uint32)), 0
            for i in range(len(strings)):
                if i in parts:
                    out.append(parts[i])
                    counts[i] = len(parts[i])
                else:
                    out.append(flat[at : at + counts[i]])
                    at += int(counts[i])
            return np.concatenate(out) if out else flat, np.concatenate([[0], np.cumsum(counts)])
        return (slots[0][1] if slots else np.zeros(0, np.uint32)), np.concatenate([[0], np.cumsum(counts)])
