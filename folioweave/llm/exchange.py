"""Meeting of hashed keys from groups of documents, in compressed blocks instead of rows.

Documents are dealt into groups by a hash of their id and text, so rows without an
id, or of one id, spread. Each group sends each of its distinct keys once,
whatever the number of documents that hold it, so a key that a third of all
documents share costs one entry per group. Keys travel as
sorted, delta-coded blocks, one row for each (group, bucket); a bucket's reducer
answers each group. Keys are linear in the text; blocks are as many as groups times
buckets, which is their square: 5e5 at 30 GB, and what bounds this form beyond a few TB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import trimmed

GROUP_BYTES, LEAST_GROUPS = 32 << 20, 64
DOCS = 9


def pack(x: np.ndarray, delta: bool = True) -> bytes:
    """Unsigned integers, ascending for good compression: deltas, byte planes, zstd."""
    x = np.ascontiguousarray(x)
    d = np.diff(x, prepend=x.dtype.type(0)) if delta else x
    planes = d.view(np.uint8).reshape(len(d), x.itemsize).T if len(d) else d.view(np.uint8)
    return (x.dtype.str + "+-"[delta]).encode().ljust(4) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(b: bytes) -> np.ndarray:
    kind = np.dtype(b[:3].decode())
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[4:]), np.uint8)
    d = np.ascontiguousarray(flat.reshape(kind.itemsize, -1).T).view(kind).ravel() if len(flat) else np.zeros(0, kind)
    return np.cumsum(d, dtype=kind) if b[3:4] == b"-" else d


def join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split(b: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(b):
        n = int.from_bytes(b[at : at + 8], "little")
        out.append(b[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]


def counts_for(total: int) -> tuple[int, int]:
    """Groups and buckets (a power of two), both in proportion to the bytes of text."""
    groups = max(LEAST_GROUPS, -(-total // GROUP_BYTES))
    return groups, 1 << max(5, (groups // 2).bit_length())


def in_groups(docs: DataFrame, replies: dict[int, DataFrame], groups: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Each group's replies (grp, bucket, payload) under their kinds, then its documents (doc_id, text and the carried columns), in one partition and in order."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("grp"), F.lit(DOCS).alias("kind"), F.lit(0).alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("binary").alias("payload"), *carried
    )
    for kind, reply in replies.items():
        rows = rows.unionByName(reply.select("grp", F.lit(kind).alias("kind"), "bucket", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"), "payload", *[F.lit(None).cast(kinds[c]).alias(c) for c in carried]))
    return rows.repartition(groups, "grp").sortWithinPartitions("grp", "kind", "bucket", "doc_id")


def by_group(fn: Callable[[int, dict[int, dict[int, bytes]], pa.Table], Iterator[pa.RecordBatch]]):
    """For mapInArrow over in_groups(): calls fn(group, {kind: {bucket: payload}}, documents) for each group."""

    def run(batches):
        now, replies, docs = None, {}, []

        def flush():
            if docs:
                yield from fn(now, replies, pa.Table.from_batches(docs))

        for batch in batches:
            grp = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)] if len(grp) else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                if grp[a] != now:
                    yield from flush()
                    now, replies, docs = grp[a], {}, []
                part = batch.slice(a, b - a)
                kinds = part.column(1).to_numpy()
                m = int(np.searchsorted(kinds, DOCS))
                for i in range(m):
                    replies.setdefault(int(kinds[i]), {}).setdefault(part.column(2)[i].as_py(), part.column(5)[i].as_py())
                if m < len(part):
                    docs.append(part.slice(m).select(["doc_id", "text", *part.schema.names[6:]]))
        yield from flush()

    return trimmed(run)


def in_buckets(blocks: DataFrame, buckets: int) -> DataFrame:
    """The blocks (bucket, grp, payload) of each bucket in one partition, in order."""
    return blocks.select("bucket", "grp", "payload").repartition(buckets, "bucket").sortWithinPartitions("bucket", "grp")


def by_bucket(fn: Callable[[list[int], list[bytes]], list[bytes | None]]):
    """For mapInArrow over in_buckets(): fn gets a bucket's groups and blocks and gives each group's answer or None; rows (grp, bucket, payload)."""

    def run(batches):
        now, groups, blocks = None, [], []

        def flush():
            if groups:
                answers = [(g, x) for g, x in zip(groups, fn(groups, blocks), strict=True) if x is not None]
                for i in range(0, len(answers), 64):
                    part = answers[i : i + 64]
                    yield pa.record_batch([pa.array([g for g, _ in part], pa.int32()), pa.array([now] * len(part), pa.int32()), pa.array([x for _, x in part], pa.binary())], ["grp", "bucket", "payload"])

        for batch in batches:
            for bucket, grp, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now:
                    yield from flush()
                    now, groups, blocks = bucket, [], []
                groups.append(grp)
                blocks.append(payload)
        yield from flush()

    return trimmed(run)


REPLY = "grp int, bucket int, payload binary"


def census(groups: list[int], blocks: list[bytes]) -> list[bytes | None]:
    """A bucket's blocks join(keys, counts): answers each group with its keys that two or more documents hold and, for each, in how many."""
    keys, counts = zip(*(map(unpack, split(b)) for b in blocks), strict=True)
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    ranked = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    totals = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    mine = np.empty(len(flat), np.int64)
    mine[order] = np.repeat(totals, np.diff(np.append(first, len(flat))))
    out, at = [], 0
    for k in keys:
        total = mine[at : at + len(k)]
        at += len(k)
        shared = total > 1
        out.append(join(pack(k[shared]), np.minimum(total[shared], 2**32 - 1).astype(np.uint32).tobytes()) if shared.any() else None)
    return out


def prefixed(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 further bits as one number, in the same order as the hashes."""
    return h >> np.uint64(64 - 32 - (buckets.bit_length() - 1))


def census_blocks(grp: int, h: np.ndarray, n: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """Rows (bucket, grp, payload) for census(): h ascending and distinct after prefixed(), n documents of each."""
    cut = np.searchsorted(h >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    for k in range(buckets):
        if cut[k] < cut[k + 1]:
            part = slice(cut[k], cut[k + 1])
            yield k, grp, join(pack((h[part] & np.uint64(2**32 - 1)).astype(np.uint32)), pack(np.minimum(n[part], 2**32 - 1).astype(np.uint32)))


def shared_keys(reply: dict[int, bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """All answers of census() to one group: prefixed() keys, ascending, and counts."""
    if not reply:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    keys, counts = [], []
    for bucket in sorted(reply):
        k, n = split(reply[bucket])
        keys.append(unpack(k).astype(np.uint64) | (np.uint64(bucket) << np.uint64(32)))
        counts.append(np.frombuffer(n, np.uint32))
    return np.concatenate(keys), np.concatenate(counts)


def found(keys: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether it is among the ascending ones, and where."""
    if not len(among):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
    return among[at] == keys, at
