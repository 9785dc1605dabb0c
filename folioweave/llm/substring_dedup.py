"""Removal of word passages that also stand in an earlier document, by difference-cover anchors.

A difference cover D of a period v holds, for any two places i and j, a shift
d < v with (i + d) mod v and (j + d) mod v both in D. So two equal windows of
`window` words, wherever they stand, share an anchor: the window - v + 1 words
from a place whose number modulo v is in D. Only anchors are counted over the
corpus; windows around anchors that two documents share are then extended to
full windows and compared by hashes of together 96 bits, taken from two word
hashes under keys that each run draws anew.

Defined results: null text is empty, a null id counts as larger than every
other (and nothing is removed between rows without one), rows that repeat an id
count as one document for the comparison, texts of fewer than `window` words
lose nothing, other columns are ignored unless they are carried. One document's
word hashes (about twice its text) must fit a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import exchange as ex
from .store import stage, tune
from .words import Hasher, Words, grams, secret

PERIOD, COVER = 7, (0, 1, 3)
U = np.uint64
BLOCKS = "bucket int, grp int, payload binary"


class Passages:
    """The documents of one group as words."""

    def __init__(self, table: pa.Table, window: int, keys: tuple[int, int]):
        self.words, self.window, self.second = Words(table["text"], Hasher(key=keys[0])), window, Hasher(key=keys[1])
        # Ids as unsigned numbers of the same order; those without one (none) come behind all.
        self.none = table["doc_id"].is_null().to_numpy().astype(bool)
        self.ids = table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy().astype(np.int64).view(U) ^ U(1 << 63)
        counts = self.words.counts
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.place = np.arange(len(self.doc)) - self.words.first[self.doc]
        self.left = counts[self.doc] - self.place

    def anchors(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers at cover places and the keys of their anchors."""
        n = self.window - PERIOD + 1
        at = np.flatnonzero(np.isin(self.place % PERIOD, COVER) & (self.left >= n))
        return at, ex.prefixed(grams(self.words.hash, n, 0xA5A5)[at], buckets)

    def census(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor keys and the number of documents that hold each."""
        at, key = self.anchors(buckets)
        _, rank = np.unique(np.stack([self.none.astype(U), self.ids]), axis=1, return_inverse=True)
        bits = U(max(1, int(len(self.ids)).bit_length()))
        pairs = np.unique((key << bits) | rank[self.doc[at]].astype(U))
        return np.unique(pairs >> bits, return_counts=True)

    def windows(self, shared: np.ndarray, buckets: int):
        """Windows that hold a shared anchor: first words, two hashes; and by hash the order, the firsts of equal ones."""
        at, key = self.anchors(buckets)
        hit = np.zeros(len(self.doc) + PERIOD + 1, np.int32)
        hit[at[ex.found(key, shared)[0]] + 1] = 1
        total = np.cumsum(hit)
        n = len(self.doc)
        start = np.flatnonzero((total[PERIOD : PERIOD + n] > total[:n]) & (self.left >= self.window))
        a, b = grams(self.words.hash, self.window, 0xB17)[start], grams(self.words.also(self.second), self.window, 0xC0DE5)[start] >> U(32)
        order = np.lexsort((self.none[self.doc[start]], self.ids[self.doc[start]], b, a))
        a, b, start = a[order], b[order].astype(np.uint32), start[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return start, a, b, new


def _cuts(a: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(a >> U(64 - (buckets.bit_length() - 1)), np.arange(buckets + 1, dtype=U))


def _batch(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(rows), 32):
        bucket, grp, payload = zip(*rows[i : i + 32], strict=True)
        yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array([int(g) for g in grp], pa.int32()), pa.array(payload, pa.binary())], ["bucket", "grp", "payload"])


def _earliest(groups: list[int], blocks: list[bytes]) -> list[bytes | None]:
    """For each group's windows in order whether another group holds the same in a document with a smaller id."""
    parts = [ex.split(b) for b in blocks]
    a, b, doc, none = (np.concatenate(x) for x in zip(*((ex.unpack(p[0]), np.frombuffer(p[1], np.uint32), ex.unpack(p[2]), np.unpackbits(np.frombuffer(p[3], np.uint8), count=len(p[1]) // 4)) for p in parts), strict=True))
    order = np.lexsort((none, doc, b, a))
    new = np.ones(len(a), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    first = np.flatnonzero(new)
    best = np.empty(len(a), np.int64)
    best[order] = np.repeat(order[first], np.diff(np.append(first, len(a))))
    later, at, out = (doc[best] < doc) | ((doc[best] == doc) & (none[best] < none)), 0, []
    for p in parts:
        n = len(p[1]) // 4
        flags = later[at : at + n]
        at += n
        out.append(np.packbits(flags).tobytes() if flags.any() else None)
    return out


def substring_dedup(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", carried: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text: the words that no earlier document's equal window covers, joined by a space. carried: a column that each row keeps, with `text` in place of kept_text, which is the row's own where nothing is removed."""
    if window < PERIOD + 1:
        raise ValueError(f"window must be over {PERIOD}")
    kept_columns = [F.col(carried).alias("carried")] if carried else []
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *kept_columns)
    spark = docs.sparkSession
    tune(spark)
    groups, buckets = ex.counts_for(ex.text_bytes(docs, "text"))
    keys, names = (secret(), secret()), ["doc_id", "n_words", "n_removed", "text" if carried else "kept_text", *[carried] * bool(carried)]

    def count_anchors(grp, replies, table):
        found, n = Passages(table, window, keys).census(buckets)
        yield from _batch(list(ex.census_blocks(grp, found, n, buckets)))

    def send_windows(grp, replies, table):
        shared, _ = ex.shared_keys(replies.get(1))
        if not len(shared):
            return
        p = Passages(table, window, keys)
        start, a, b, new = p.windows(shared, buckets)
        doc = p.doc[start[new]]
        a, b, least, none = a[new], b[new], p.ids[doc], p.none[doc]
        cut = _cuts(a, buckets)
        rows = [(k, grp, ex.join(ex.pack(a[s:e]), b[s:e].tobytes(), ex.pack(least[s:e], delta=False), np.packbits(none[s:e]).tobytes())) for k, (s, e) in enumerate(zip(cut, cut[1:], strict=False)) if s < e]
        yield from _batch(rows)

    def remove(grp, replies, table):
        p = Passages(table, window, keys)
        gone = np.zeros(len(p.doc) + 1, np.int32)
        shared, _ = ex.shared_keys(replies.get(1))
        if len(shared):
            start, a, b, new = p.windows(shared, buckets)
            first = np.flatnonzero(new)
            flags, cut = np.zeros(len(first), bool), _cuts(a[new], buckets)
            for k, bits in replies.get(2, {}).items():
                flags[cut[k] : cut[k + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(cut[k + 1] - cut[k]))
            size = np.diff(np.append(first, len(a)))
            ids, none = p.ids[p.doc[start]], p.none[p.doc[start]]
            least, known = np.repeat(ids[first], size), ~np.repeat(none[first], size)
            out = start[np.repeat(flags, size) | (ids > least) | (none & known)]
            np.add.at(gone, out, 1)
            np.add.at(gone, out + window, -1)
        covered = np.cumsum(gone)[:-1] > 0
        n_removed = np.diff(np.concatenate([[0], np.cumsum(covered)])[p.words.first])
        data, offsets, first, counts = p.words.data.tobytes(), p.words.offsets.tolist(), p.words.first.tolist(), p.words.counts
        valid = table["text"].is_valid().to_numpy()
        columns, i = [table[c].combine_chunks() for c in ("doc_id", "text", *["carried"] * bool(carried))], 0
        while i < len(counts):
            j, kept, size = i, [], 0
            while j < len(counts) and (not kept or size + offsets[j + 1] - offsets[j] <= 8 << 20):
                raw = data[offsets[j] : offsets[j + 1]]
                if n_removed[j]:
                    kept.append(b" ".join(w for w, c in zip(raw.split(), covered[first[j] : first[j + 1]].tolist(), strict=True) if not c))
                elif carried:
                    kept.append(raw if valid[j] else None)
                else:
                    kept.append(b" ".join(raw.split()))
                size += len(raw)
                j += 1
            ids, _, *more = (c.slice(i, j - i) for c in columns)
            yield pa.record_batch([ids, pa.array(counts[i:j], pa.int64()), pa.array(n_removed[i:j], pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), *more], names)
            i = j

    texts = docs.select("doc_id", "text")
    sent = stage(ex.in_groups(texts, {}, groups).mapInArrow(ex.by_group(count_anchors), BLOCKS), "anchors")
    shared = stage(ex.in_buckets(sent.df, buckets).mapInArrow(ex.by_bucket(ex.census), ex.REPLY), "shared-anchors")
    sent.drop()
    sent = stage(ex.in_groups(texts, {1: shared.df}, groups).mapInArrow(ex.by_group(send_windows), BLOCKS), "windows")
    later = stage(ex.in_buckets(sent.df, buckets).mapInArrow(ex.by_bucket(_earliest), ex.REPLY), "later-windows")
    sent.drop()
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(names[3], T.StringType())])
    if carried:
        out = out.add(carried, docs.schema["carried"].dataType)
    return ex.in_groups(docs, {1: shared.df, 2: later.df}, groups, ("carried",) * bool(carried)).mapInArrow(ex.by_group(remove), out)
