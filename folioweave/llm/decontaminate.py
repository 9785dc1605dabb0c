"""Benchmark items that stand inside documents: size-partitioned MinHash containment search, verified exactly.

An item is contained when at least `threshold` of its distinct shingles (n
consecutive words, A-Z lower-cased) stand in the document. Items are
partitioned by size into powers of two; the MinHash sketch of an item holds its
k smallest shingle hashes, where k is one more than an item of its partition
may lack. So a document that contains the item holds at least one hash of the
sketch, however long the document is: the search misses nothing, which a sketch
of the documents could not promise for short items. Documents with a hit are
verified on the words themselves.

Items of together at most BLOCK_BYTES of text go to all tasks as one index. More
items stay a table: their sketches and the documents' distinct shingle hashes
meet by hash in buckets (exchange), documents that hold a sketch hash are joined
with the items of that hash, and each pair is verified. No process then holds
more than its share of the items, and the documents are read twice however many
items there are. Both ways give the same rows.

Defined results: null texts are empty; items without words are contained in
nothing; an item of fewer than n words is one shingle of that many words; rows
that repeat give repeated results, and null ids stay null; texts may have any
length and are searched whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .exchange import found
from .store import stage, trimmed, tune
from .words import Hasher, Words, grams

BLOCK_BYTES = 4 << 20
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"
SEED = 0x5EED
U = np.uint64


class Index:
    """Sketches and shingles of a bounded block of items."""

    def __init__(self, rows: list[tuple[int, str | None]], n: int, threshold: float):
        self.items = []
        w = Words(pa.array([t for _, t in rows], pa.string()), Hasher(True))
        sketch: dict[int, tuple[list, list]] = {}
        for i, (item_id, _) in enumerate(rows):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if a == b:
                continue
            size = min(n, b - a)
            hashes = grams(w.hash[a:b], size, SEED)
            words = [w.word(k).lower() for k in range(a, b)]
            shingles = {b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)}
            distinct = np.unique(hashes)
            most = (1 << len(shingles).bit_length()) - 1
            k = most - int(np.ceil(threshold * most - 1e-9)) + 1
            keys, owners = sketch.setdefault(size, ([], []))
            keys.append(distinct[:k])
            owners.append(np.full(len(distinct[:k]), len(self.items)))
            self.items.append((item_id, size, shingles, distinct, int(np.ceil(threshold * len(shingles) - 1e-9))))
        self.sketch = {}
        for size, (keys, owners) in sketch.items():
            key, owner = np.concatenate(keys), np.concatenate(owners)
            order = np.argsort(key, kind="stable")
            distinct, first = np.unique(key[order], return_index=True)
            self.sketch[size] = distinct, np.append(first, len(key)), owner[order]

    def search(self, w: Words):
        """(document, item, shared shingles) of all items that documents of the batch contain."""
        for size, (keys, first, owner) in self.sketch.items():
            h = grams(w.hash, size, SEED)
            hit, at = found(h, keys)
            places = np.flatnonzero(hit)
            doc = np.searchsorted(w.first, places, "right") - 1
            pairs = {(d, int(o)) for p, d in zip(places.tolist(), doc.tolist(), strict=True) if p + size <= w.first[d + 1] for o in owner[first[at[p]] : first[at[p] + 1]]}
            for d, o in sorted(pairs):
                _, _, shingles, distinct, need = self.items[o]
                a, b = int(w.first[d]), int(w.first[d + 1]) - size + 1
                spots = a + np.flatnonzero(found(h[a:b], distinct)[0])
                shared = {x for p in spots.tolist() if (x := b" ".join(w.word(p + k).lower() for k in range(size))) in shingles}
                if len(shared) >= need:
                    yield d, o, len(shared)


def _matches(index_of):
    """For mapInArrow over (doc_id, text, ...): rows of SCHEMA for the items of index_of(batch) that each document contains."""

    def run(batches):
        hasher = Hasher(True)
        for batch in batches:
            index, w = index_of(batch), Words(batch.column(1), hasher)
            rows = [(batch.column(0)[d].as_py(), index.items[o][0], len(index.items[o][2]), k, k / len(index.items[o][2])) for d, o, k in index.search(w)]
            if rows:
                ids, item, size, shared, share = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(item, pa.int64()), pa.array(size, pa.int64()), pa.array(shared, pa.int64()), pa.array(share, pa.float64())], [f.split()[0] for f in SCHEMA.split(", ")])

    return trimmed(run)


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = 0.75, n: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_shared and containment of each pair at or over the threshold."""
    tune(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    if ex.text_bytes(items, "text") > BLOCK_BYTES:
        return _by_table(docs, items, threshold, n)
    index = Index([(r["item_id"], r["text"]) for r in items.collect()], n, threshold)
    return docs.mapInArrow(_matches(lambda _: index), SCHEMA)


def _by_table(docs: DataFrame, items: DataFrame, threshold: float, n: int) -> DataFrame:
    items = stage(items.withColumn("ik", F.monotonically_increasing_id()), "items").df
    groups, buckets = ex.counts_for(ex.text_bytes(docs, "text"))

    def sketch(batches):
        for batch in batches:
            index = Index(list(zip(batch.column("ik").to_pylist(), batch.column("text").to_pylist(), strict=True)), n, threshold)
            for size, (keys, first, owner) in index.sketch.items():
                key = np.repeat(ex.prefixed(keys, buckets), np.diff(first)).view(np.int64)
                yield pa.record_batch([pa.array(np.full(len(key), size), pa.int32()), pa.array(key), pa.array([index.items[o][0] for o in owner.tolist()], pa.int64())], ["size", "key", "ik"])

    def asked(batches):
        for batch in batches:
            key = np.unique(batch.column("key").to_numpy()).view(U)
            for b in np.unique(key >> U(32)).tolist():
                part = (key[key >> U(32) == U(b)] & U(2**32 - 1)).astype(np.uint32)
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([-1], pa.int32()), pa.array([ex.pack(part)], pa.binary())], ["bucket", "grp", "payload"])

    sketches = stage(items.select("ik", "text").mapInArrow(sketch, "size int, key long, ik long"), "sketches").df
    sizes = [r["size"] for r in sketches.select("size").distinct().collect()]  # at most n

    def keys_of(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places of words where a shingle stands, and its key."""
        at = np.arange(max(0, len(w.hash) - size + 1))
        inside = at + size <= w.first[np.searchsorted(w.first, at, "right")]
        return at[inside], ex.prefixed(grams(w.hash, size, SEED)[inside], buckets)

    def send(grp, replies, table):
        w = Words(table["text"], Hasher(True))
        key = np.unique(np.concatenate([np.zeros(0, U), *(keys_of(w, size)[1] for size in sizes)]))
        cut = np.searchsorted(key >> U(32), np.arange(buckets + 1, dtype=U))
        for b in range(buckets):
            if cut[b] < cut[b + 1]:
                part = (key[cut[b] : cut[b + 1]] & U(2**32 - 1)).astype(np.uint32)
                yield pa.record_batch([pa.array([b], pa.int32()), pa.array([int(grp)], pa.int32()), pa.array([ex.pack(part)], pa.binary())], ["bucket", "grp", "payload"])

    def meet(groups_, blocks):
        keys = [ex.unpack(b) for b in blocks]
        wanted = np.unique(np.concatenate([np.zeros(0, np.uint32), *(k for g, k in zip(groups_, keys, strict=True) if g < 0)]))
        hits = [k[found(k, wanted)[0]] if g >= 0 else k[:0] for g, k in zip(groups_, keys, strict=True)]
        return [ex.pack(h) if len(h) else None for h in hits]

    def pick(grp, replies, table):
        if 1 not in replies:
            return
        shared = np.concatenate([ex.unpack(x).astype(U) | U(b) << U(32) for b, x in sorted(replies[1].items())])
        w, held = Words(table["text"], Hasher(True)), {}
        for size in sizes:
            at, key = keys_of(w, size)
            hit = np.flatnonzero(found(key, shared)[0])
            doc = np.searchsorted(w.first, at[hit], "right") - 1
            for d, k in set(zip(doc.tolist(), key[hit].tolist(), strict=True)):
                held.setdefault(d, []).append(k)
        for d, keys in held.items():
            yield pa.record_batch([table["doc_id"].combine_chunks().slice(d, 1), table["text"].combine_chunks().slice(d, 1), pa.array([np.array(keys, U).view(np.int64)], pa.list_(pa.int64()))], ["doc_id", "text", "keys"])

    blocks = "bucket int, grp int, payload binary"
    sent = ex.in_groups(docs, {}, groups).mapInArrow(ex.by_group(send), blocks).unionByName(sketches.select("key").mapInArrow(asked, blocks))
    sent = stage(sent, "item-blocks")
    reply = stage(ex.in_buckets(sent.df, buckets).mapInArrow(ex.by_bucket(meet), ex.REPLY), "item-hits")
    sent.drop()
    held = stage(ex.in_groups(docs, {1: reply.df}, groups).mapInArrow(ex.by_group(pick), "doc_id long, text string, keys array<long>").withColumn("dk", F.monotonically_increasing_id()), "suspects").df
    pairs = held.select("dk", F.explode("keys").alias("key")).join(sketches.select("key", "ik"), "key").select("dk", "ik").distinct()
    rows = pairs.join(held.drop("keys"), "dk").join(items.select("ik", "item_id", F.col("text").alias("item")), "ik").select("doc_id", "text", "item_id", "item")

    def verify(batches):
        # A batch is one pair, so that only its own item is looked for.
        one = (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows))
        yield from _matches(lambda b: Index([(b.column("item_id")[0].as_py(), b.column("item")[0].as_py())], n, threshold))(one)

    return rows.mapInArrow(verify, SCHEMA)
