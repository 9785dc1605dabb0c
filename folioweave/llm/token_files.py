"""Token ids in files of wavelet matrices.

A shard's ids are stored as bit planes, the highest bit first. Behind each
plane the ids are split stably by that bit, zeros first, and the next plane
shows them in that order. Ones are counted up to each block of BLOCK bits, so
rank takes one look-up and a count of a block's bits, select a binary search.
Each plane adds one rank step to the access of a token, to counting an id up to
a place, and to finding its k-th place; nothing else is decoded.

A file holds rows (part, shard, n_tokens, doc_ids, without_id, lengths, wavelet);
documents stand in ascending id, over parts and shards. Parquet compresses the planes.

Defined results: null text is empty and holds the end id alone, null ids come
first, rows that repeat are stored each by itself, texts may have any length,
other columns are ignored, an empty table has no shards.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exchange as ex
from .store import Staged, stage, trimmed, tune
from .tokens import Encoder

BLOCK = 512
SHARD_TOKENS = 2_000_000
PART_BYTES, LEAST_PARTS = 32 << 20, 64
FILE = "part int, shard int, n_tokens long, doc_ids binary, without_id binary, lengths binary, wavelet binary"


class WaveletMatrix:
    """Access, rank, select and whole decoding over one shard's bytes."""

    def __init__(self, raw: bytes):
        self.n, self.depth = struct.unpack_from("<QQ", raw)
        at = 16
        self.zeros = np.frombuffer(raw, "<u8", self.depth, at).astype(np.int64)
        at += 8 * self.depth
        blocks, width = -(-self.n // BLOCK) + 1, -(-self.n // 8)
        self.ranks, self.planes = [], []
        for _ in range(self.depth):
            self.ranks.append(np.frombuffer(raw, "<u4", blocks, at))
            at += 4 * blocks
            self.planes.append(np.frombuffer(raw, np.uint8, width, at))
            at += width

    @staticmethod
    def build(ids: np.ndarray) -> bytes:
        n = len(ids)
        depth = max(1, int(ids.max(initial=0)).bit_length())
        now = ids.astype(np.uint16 if depth <= 16 else np.uint32)
        zeros, parts = [], []
        for k in range(depth - 1, -1, -1):
            bit = (now >> k) & 1
            one = bit.astype(bool)
            padded = np.zeros(-(-n // BLOCK) * BLOCK, np.uint8)
            padded[:n] = bit
            rank = np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(1, dtype=np.int64))]).astype("<u4")
            parts += [rank.tobytes(), np.packbits(one, bitorder="little").tobytes()]
            zeros.append(n - int(rank[-1]))
            now = np.concatenate([now[~one], now[one]])
        return struct.pack("<QQ", n, depth) + np.array(zeros, "<u8").tobytes() + b"".join(parts)

    def _ones(self, plane: int, i: int) -> int:
        """Ones before place i."""
        block = i // BLOCK
        bits = np.unpackbits(self.planes[plane][block * BLOCK // 8 : -(-i // 8)], bitorder="little")
        return int(self.ranks[plane][block]) + int(bits[: i - block * BLOCK].sum())

    def access(self, i: int) -> int:
        value = 0
        for k in range(self.depth):
            bit = int(self.planes[k][i >> 3] >> (i & 7)) & 1
            ones = self._ones(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the token's occurrences before i stand behind the last plane."""
        a, b = 0, i
        for k in range(self.depth):
            one_a, one_b = self._ones(k, a), self._ones(k, b)
            if token >> (self.depth - 1 - k) & 1:
                a, b = int(self.zeros[k]) + one_a, int(self.zeros[k]) + one_b
            else:
                a, b = a - one_a, b - one_b
        return a, b

    def rank(self, token: int, i: int) -> int:
        """Occurrences of the token before place i."""
        if token >> self.depth:
            return 0
        a, b = self._range(token, i)
        return b - a

    def select(self, token: int, k: int) -> int:
        """Place of the token's k-th occurrence, from 0."""
        if not 0 <= k < self.rank(token, self.n):
            raise IndexError(k)
        i = self._range(token, self.n)[0] + k
        for p in range(self.depth - 1, -1, -1):
            bit = token >> (self.depth - 1 - p) & 1
            want = i - int(self.zeros[p]) if bit else i
            block = np.arange(len(self.ranks[p]))
            before = self.ranks[p].astype(np.int64) if bit else block * BLOCK - self.ranks[p].astype(np.int64)
            b = int(np.searchsorted(before[:-1], want, "right")) - 1
            bits = np.unpackbits(self.planes[p][b * BLOCK // 8 : (b + 1) * BLOCK // 8], bitorder="little")
            bits = bits[: self.n - b * BLOCK]
            i = b * BLOCK + int(np.flatnonzero(bits == bit)[want - int(before[b])])
        return i

    def decode(self) -> np.ndarray:
        """All ids: the planes undone from the last to the first."""
        out = np.zeros(self.n, np.uint16 if self.depth <= 16 else np.uint32)
        for p in range(self.depth - 1, -1, -1):
            one = np.unpackbits(self.planes[p], count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            z = int(self.zeros[p])
            up[~one] = out[:z]
            up[one] = out[z:] | out.dtype.type(1 << (self.depth - 1 - p))
            out = up
        return out


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Staged:
    """Encode and write all documents in ascending id; the files lie in the shared folder."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tune(docs.sparkSession)
    parts = max(LEAST_PARTS, -(-ex.text_bytes(docs, "text") // PART_BYTES))
    placed = docs.withColumn("_tie", F.xxhash64("text")).repartitionByRange(parts, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")

    def run(batches):
        encoder, part, shard = Encoder.of(tokenizer, True), TaskContext.get().partitionId(), 0
        ids, doc_ids, bare, sizes, held = [], [], [], [], 0

        def close():
            lengths, names = np.concatenate(sizes), np.concatenate(doc_ids)
            flat = np.concatenate(ids)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([len(flat)], pa.int64()), pa.array([ex.pack(names.astype(np.int64).view(np.uint64))], pa.binary()), pa.array([np.packbits(np.concatenate(bare)).tobytes()], pa.binary()), pa.array([ex.pack(lengths.astype(np.uint64), delta=False)], pa.binary()), pa.array([WaveletMatrix.build(flat)], pa.binary())], [f.split()[0] for f in FILE.split(", ")])

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                found, bounds = encoder.batch(some.column(1))
                ids.append(np.insert(found, bounds[1:], end_id))
                sizes.append(np.diff(bounds) + 1)
                doc_ids.append(some.column(0).fill_null(0).to_numpy())
                bare.append(some.column(0).is_null().to_numpy(zero_copy_only=False))
                held += len(ids[-1])
                if held >= SHARD_TOKENS:
                    yield from close()
                    ids, doc_ids, bare, sizes, held, shard = [], [], [], [], 0, shard + 1
        if ids:
            yield from close()

    return stage(placed.mapInArrow(trimmed(run), FILE), "token-files")


def read_shards(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                part, shard, _, names, bare, sizes, raw = (c[row].as_py() for c in batch.columns)
                flat = memoryview(WaveletMatrix(raw).decode().astype("<u4").tobytes())
                lengths = ex.unpack(sizes).astype(np.int64)
                start = np.cumsum(lengths) - lengths
                crc = [zlib.crc32(flat[4 * a : 4 * (a + n)]) for a, n in zip(start.tolist(), lengths.tolist(), strict=True)]
                ids = ex.unpack(names).view(np.int64)
                n = len(ids)
                yield pa.record_batch([pa.array(ids, pa.int64(), mask=np.unpackbits(np.frombuffer(bare, np.uint8), count=n).astype(bool)), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64()), pa.array(np.full(n, part), pa.int32()), pa.array(np.full(n, shard), pa.int32())], ["doc_id", "at", "n_tokens", "ids_crc32", "part", "shard"])

    rows = files.select(*[f.split()[0] for f in FILE.split(", ")]).mapInArrow(run, "doc_id long, at long, n_tokens long, ids_crc32 long, part int, shard int")
    sizes = files.select("part", "shard", "n_tokens")
    # One row for each part goes through one task; shards are summed within their parts.
    whole = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("inside"))
    starts = within.join(whole, "part").select("part", "shard", (F.col("before") + F.col("inside")).alias("base"))
    return rows.join(starts, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def locate(files: DataFrame, token: int) -> DataFrame:
    """part, shard, count and place of the first occurrence of a token in each shard that holds it."""

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                w = WaveletMatrix(batch.column(2)[row].as_py())
                if n := w.rank(token, w.n):
                    yield pa.record_batch([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([n], pa.int64()), pa.array([w.select(token, 0)], pa.int64())], ["part", "shard", "n", "first"])

    return files.select("part", "shard", "wavelet").mapInArrow(run, "part int, shard int, n long, first long")
