"""Token counts of whole texts by a compiled finite-state transducer.

A SentencePiece BPE encoding is the one sequence of pieces in which every two
neighbours are what BPE makes of their concatenation. So the last piece of each
prefix follows from the last pieces of shorter prefixes, back to where a piece
may still begin. A state of the transducer holds these: for each suffix of the
prefix that begins some piece, the piece before it and the count there less the
count now. Reading a character goes to one next state and emits the change of
the count (which may be negative). States are compiled when first reached; no
piece goes on past a blank that follows another character, so each stretch of
blanks and characters starts in the first state.

Stretches are cut into chunks that run side by side. A chunk's map leads from
entry states to exit states and counts. Its first entry state comes from a run-up
over the characters before it; all states that the maps of its predecessor leave
in are added, for all chunks at once, until the maps are closed. A state that is
handed on unchanged is added to twice as many chunks each time, so rounds grow
with the logarithm of the chunks. Then a parallel prefix scan composes the maps:
pointers and counts double their reach each round.

Defined results: null and empty texts have no bytes and no tokens; each row is
counted by itself, also where ids are null or repeat; texts may have any length;
other columns are ignored; special strings inside texts are plain text, as the
library has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import found
from .store import trimmed, tune, worker_cache
from .words import Hasher, buffers, secret

BLANK = "▁"
CHUNK, RUN_UP = 64, 24
MOST_STATES, MOST_SYMBOLS = 200_000, 192
ONLY_BLANK = np.zeros(256, bool)
ONLY_BLANK[32] = True
ALONE = -1


class Merges:
    """The pieces of a BPE model: which exist, in which order they merge, how each came about."""

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        pieces = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        ranked = sorted(pieces, key=lambda i: (-sp.get_score(i), i))
        self.text = [sp.id_to_piece(i) for i in ranked]
        self.rank = {t: r for r, t in enumerate(self.text)}
        self.bytes = any(sp.is_byte(i) for i in range(sp.get_piece_size()))
        letters = {c for t in self.text for c in t}
        if missing := [c for c in letters if c not in self.rank]:
            raise ValueError(f"pieces hold characters that are no pieces: {missing[:5]}")
        if any(BLANK in t.lstrip(BLANK) for t in self.text):
            raise ValueError("a piece goes on past a blank")
        self.children: list[dict[str, int]] = [{}]
        self.piece: list[int | None] = [None]
        self._parts: dict[int, tuple[int, int] | None] = {}
        for t, r in self.rank.items():
            if self.parts(r) is None and len(t) > 1:
                continue  # BPE never makes it
            at = 0
            for c in t:
                if c not in self.children[at]:
                    self.children[at][c] = len(self.children)
                    self.children.append({})
                    self.piece.append(None)
                at = self.children[at][c]
            self.piece[at] = r
        self._fits: dict[tuple[int, int], bool] = {}

    def merged(self, symbols: list[int]) -> tuple[list[int], tuple[int, int] | None]:
        """BPE over pieces, and the last pair it merged."""
        last = None
        while len(symbols) > 1:
            best, at = None, 0
            for i in range(len(symbols) - 1):
                r = self.rank.get(self.text[symbols[i]] + self.text[symbols[i + 1]])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            last = symbols[at], symbols[at + 1]
            symbols[at : at + 2] = [best]
        return symbols, last

    def parts(self, r: int) -> tuple[int, int] | None:
        if r not in self._parts:
            out, last = self.merged([self.rank[c] for c in self.text[r]])
            self._parts[r] = last if out == [r] else None
        return self._parts[r]

    def fits(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two as they are when they stand together."""
        if left == ALONE:
            return True
        key = left, right
        if key not in self._fits:
            self._fits[key] = self._apart(left, right)
        return self._fits[key]

    def _apart(self, left: int, right: int) -> bool:
        """Undo the merges of both, the latest first; a pair across the border that would have come before is a misfit."""
        limit = len(self.text) + 1
        while True:
            r = self.rank.get(self.text[left] + self.text[right])
            if r is not None and r < limit:
                return False
            a, b = self.parts(left), self.parts(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]


class Transducer:
    """States and transitions over characters, compiled as texts need them."""

    def __init__(self, merges: Merges):
        self.m, self.symbols = merges, {}
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = [()]
        self.next = np.zeros((MOST_STATES + 1, MOST_SYMBOLS), np.int32)
        self.emit = np.zeros((MOST_STATES + 1, MOST_SYMBOLS), np.int8)
        self.rare: dict[tuple[int, str], tuple[int, int]] = {}
        self.first = self.state(((0, ALONE, 0),))

    def state(self, key: tuple) -> int:
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
        return self.states[key]

    def step(self, state: int, c: str) -> tuple[int, int]:
        """Next state and emitted count. A state's key: (trie node, piece before it, count there less the count now) by suffix, the empty suffix last."""
        m = self.m
        if c not in m.rank:
            return self.first, len(c.encode()) if m.bytes else 1
        live, now = [], None
        for node, before, less in self.keys[state]:
            to = m.children[node].get(c)
            if to is None:
                continue
            piece = m.piece[to]
            if now is None and piece is not None and m.fits(before, piece):
                now = piece, less + 1
            if m.children[to]:
                live.append((to, before, less))
        piece, emitted = now
        return self.state((*((node, before, less - emitted) for node, before, less in live), (0, piece, 0))), emitted

    def run(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exit states and counts of stretches of code points from their entry states, side by side."""
        names, inverse = np.unique(chars, return_inverse=True)
        symbol = np.array([self.symbols.setdefault(chr(x), len(self.symbols)) for x in names.tolist()] or [0])[inverse]
        state, count, at = entry.astype(np.int32), np.zeros(len(starts), np.int64), starts.astype(np.int64)
        going = np.flatnonzero(at < ends)
        while len(going):
            s, x = state[going], symbol[at[going]]
            dense = x < MOST_SYMBOLS
            column = np.where(dense, x, 0)
            to, out = self.next[s, column], self.emit[s, column].astype(np.int64)
            missing = np.flatnonzero((to == 0) | ~dense)
            if len(missing):
                pairs = s[missing].astype(np.int64) << 32 | chars[at[going[missing]]]
                distinct, back = np.unique(pairs, return_inverse=True)
                steps = [self.known(int(p >> 32), chr(p & 0xFFFFFFFF)) for p in distinct.tolist()]
                to[missing] = np.array([f[0] for f in steps])[back]
                out[missing] = np.array([f[1] for f in steps])[back]
            state[going] = to
            count[going] += out
            at[going] += 1
            going = going[at[going] < ends[going]]
        return state, count

    def known(self, state: int, c: str) -> tuple[int, int]:
        x = self.symbols[c]
        if x >= MOST_SYMBOLS:
            if (state, c) not in self.rare:
                self.rare[state, c] = self.step(state, c)
            return self.rare[state, c]
        to, out = self.step(state, c)
        if len(self.keys) > MOST_STATES:
            raise MemoryError
        self.next[state, x], self.emit[state, x] = to, out
        return to, out

    def counts(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each stretch; when the states' table is full it is started anew."""
        step = len(starts)
        out, i = np.zeros(len(starts), np.int64), 0
        while i < len(starts):
            j = min(len(starts), i + step)
            try:
                out[i:j] = self._counts(chars, starts[i:j], ends[i:j])
                i = j
            except MemoryError:
                self.clear()
                step = max(1, step // 4)
        return out

    def _counts(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        pieces = np.maximum(1, -(-(ends - starts) // CHUNK))
        first = np.cumsum(pieces) - pieces
        owner = np.repeat(np.arange(len(starts)), pieces)
        number = np.arange(len(owner)) - first[owner]
        a = starts[owner] + number * CHUNK
        b = np.minimum(a + CHUNK, ends[owner])
        last = number == pieces[owner] - 1
        entry = np.full(len(a), self.first, np.int32)
        later = np.flatnonzero(number)
        if len(later):
            entry[later] = self.run(chars, a[later] - RUN_UP, a[later], np.full(len(later), self.first))[0]
        # Rows of the chunks' maps: (chunk, entry state) to (exit state, count), until each exit is an entry of the next chunk.
        keys, leave, count = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        new, age = np.arange(len(a)) << 32 | entry.astype(np.int64), np.zeros(len(a), np.int64)
        self.closing = 0
        while len(new):
            chunk, state = new >> 32, new & 0xFFFFFFFF
            to, n = self.run(chars, a[chunk], b[chunk], state)
            to = to.astype(np.int64)
            spot = np.searchsorted(keys, new)
            keys, leave, count = np.insert(keys, spot, new), np.insert(leave, spot, to), np.insert(count, spot, n)
            goes = ~last[chunk]
            asked, age = (chunk + 1 << 32 | to)[goes], age[goes]
            missing = ~found(asked, keys)[0]
            asked, age = asked[missing], age[missing]
            # A state that is handed on from chunk to chunk is tried in twice as many chunks each time.
            reach = np.minimum(1 << np.minimum(age, 40), (first + pieces)[owner[asked >> 32]] - (asked >> 32))
            step = np.arange(int(reach.sum())) - np.repeat(np.cumsum(reach) - reach, reach)
            new, age = np.repeat(asked, reach) + (step << 32), np.repeat(age + 1, reach)
            order = np.lexsort((-age, new))
            new, age = new[order], age[order]
            fresh = ~found(new, keys)[0]
            fresh[1:] &= new[1:] != new[:-1]
            new, age = new[fresh], age[fresh]
            self.closing += 1
        # Composition by doubling: each row's count comes to cover twice as many chunks, and points behind them.
        chunk = keys >> 32
        follow = np.where(last[chunk], -1, found(chunk + 1 << 32 | leave, keys)[1])
        self.doublings = 0
        while len(on := np.flatnonzero(follow >= 0)):
            count[on], follow[on] = count[on] + count[follow[on]], follow[follow[on]]
            self.doublings += 1
        return count[found(first << 32 | self.first, keys)[1]]


def batch_counts(texts: pa.Array, t: Transducer, hasher: Hasher, check: Hasher | None = None) -> np.ndarray:
    """Tokens of each text. Stretches that are equal by two hashes, the second under a secret key, are counted once per batch."""
    hashers = hasher, check or Hasher(key=secret())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if pc.any(pc.match_substring(texts, BLANK)).as_py():
        texts = pc.replace_substring(texts, BLANK, " ")
    data, offsets = buffers(pc.binary_join_element_wise(pa.scalar(""), texts, pa.scalar(" ")))
    blank = data == 32
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(data))
    one, two = (h.hashes(data, starts, ends) for h in hashers)
    _, first, inverse = np.unique(one, return_index=True, return_inverse=True)
    if not np.array_equal(two[first][inverse], two):
        first = inverse = np.arange(len(starts))  # two stretches share a hash: count each
    s, e = starts[first], ends[first]
    flat = np.repeat(s - np.concatenate([[0], np.cumsum(e - s)[:-1]]), e - s) + np.arange(int((e - s).sum())) if len(s) else np.zeros(0, np.int64)
    picked = data[flat]
    chars = np.frombuffer(picked.tobytes().decode().replace(" ", BLANK).encode("utf-32-le"), np.uint32).astype(np.int64)
    before = np.concatenate([[0], np.cumsum((picked & 0xC0) != 0x80)])
    cut = np.concatenate([[0], np.cumsum(e - s)])
    count = t.counts(chars, before[cut[:-1]], before[cut[1:]])[inverse]
    total = np.concatenate([[0], np.cumsum(count)])
    at = np.searchsorted(starts, offsets)
    out = total[at[1:]] - total[at[:-1]]
    out[empty] = 0
    return out


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row. model_file: a SentencePiece BPE model without normalization."""
    tune(docs.sparkSession)

    def run(batches):
        cache = worker_cache()
        if ("counts", model_file) not in cache:
            cache["counts", model_file] = Transducer(Merges(model_file))
        t, hashers = cache["counts", model_file], (Hasher(space=ONLY_BLANK, key=secret()), Hasher(key=secret()))
        for batch in batches:
            n = batch_counts(batch.column(1), t, *hashers)
            size = np.diff(buffers(batch.column(1))[1])
            yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
