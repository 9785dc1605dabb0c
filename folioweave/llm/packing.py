"""Packing of token sequences into bins of fixed length by a configuration linear program.

The program has a variable for each way to fill a bin (a configuration) and a
row for each piece length: cover the histogram of lengths with as few bins as
possible. Multiplicative weights solve it: each length's price falls as it is
covered, and a knapsack dynamic program over the bin finds the configurations of
the highest price. Amounts are rounded down. What is left is solved again, with a
knapsack that takes no length more often than it is left, and rounded to whole
configurations at the program's prices, those of the longest pieces first; the
last tenth of the pieces goes best-fit decreasing, group-wise over equal bins. As
a last comparison, best fit of all pieces replaces a plan of more bins. All of
this sees the histogram alone, which has at most `length` rows whatever the
number of documents.

Pieces get their places from their rank among the pieces of equal length: each
input partition counts its own, and the partitions' counts are summed before.

Defined results: null text is empty and holds the end id alone; rows that repeat
are packed each by itself; null ids stay null; texts may have any length and only
those of over `length` tokens are cut; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stage, trimmed, tune
from .tokens import Encoder

#: Steps of the program over all pieces and over what is left.
STEPS, AGAIN = 150, 24
#: Share of the pieces that may be left for best fit after rounding.
REST = 0.1
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def knapsack(price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest total price of lengths that fit each capacity, and the length taken last there (0: none). price[l - 1] is that of length l; -inf: there is none."""
    size = len(price)
    best, last, backward = np.zeros(size + 1), np.zeros(size + 1, np.int64), np.ascontiguousarray(price[::-1])
    for cap in range(1, size + 1):
        value = best[:cap] + backward[size - cap :]
        at = int(value.argmax())
        if value[at] > best[cap - 1]:
            best[cap], last[cap] = value[at], cap - at
        else:
            best[cap] = best[cap - 1]
    return best, last


def filled(last: np.ndarray, cap: int) -> list[int]:
    """The lengths that the knapsack takes into a capacity."""
    out = []
    while cap > 0:
        if last[cap]:
            out.append(int(last[cap]))
            cap -= out[-1]
        else:
            cap -= 1
    return out


def fractional(need: np.ndarray, steps: int = STEPS, heat: float = 0.02, rate: float = 0.05) -> list[tuple[dict[int, int], float]]:
    """Amounts of configurations, by multiplicative weights.

    In each step one knapsack over the prices gives, for every length, the best
    configuration that holds it; the bins of the lower bound are dealt over these
    by their value. Prices of lengths that get more than they need fall, the
    others' rise. The amounts are means over the steps.
    """
    size, lengths = len(need), np.flatnonzero(need) + 1
    n = need[lengths - 1].astype(float)
    bins, price = float((n * lengths).sum() / size), lengths / size
    place = np.zeros(size + 1, np.int64)
    place[lengths] = np.arange(len(lengths))
    amounts: dict[tuple, float] = {}
    for step in range(steps):
        full = np.full(size, -np.inf)
        full[lengths - 1] = price
        best, last = knapsack(full)
        value = price + best[size - lengths]
        share = n * np.exp((value - value.max()) / heat)
        share *= bins / share.sum()
        use = np.zeros(len(lengths))
        for j in np.flatnonzero(share > 1e-9 * bins).tolist():
            config = sorted([int(lengths[j]), *filled(last, size - int(lengths[j]))])
            amounts[tuple(config)] = amounts.get(tuple(config), 0.0) + share[j] / steps
            np.add.at(use, place[config], share[j])
        price = price * np.exp(rate / np.sqrt(1 + step) * np.clip(1 - use / n, -1, 1))
    return sorted(((dict(Counter(c)), x) for c, x in amounts.items()), key=lambda x: -x[1])


def best_fit(need: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Best fit of the lengths in falling order; equal bins are one group, so the work does not grow with the counts."""
    size = len(need)
    groups: dict[int, Counter] = {c: Counter() for c in range(size + 1)}
    count = np.zeros(size + 1, np.int64)
    for length in np.flatnonzero(need)[::-1].tolist():
        length, n = length + 1, int(need[length])
        while n:
            fits = np.flatnonzero(count[length:])
            if len(fits):
                cap = length + int(fits[0])
                content, k = next(iter(groups[cap].items()))
            else:
                cap, content, k = size, (), -(-n // (size // length))
            each = min(cap // length, n)
            k = min(k, n // each)
            if cap < size or content:
                groups[cap][content] -= k
                if not groups[cap][content]:
                    del groups[cap][content]
                count[cap] -= k
            groups[cap - each * length][(*content, (length, each))] += k
            count[cap - each * length] += k
            n -= k * each
    return [(dict(content), k) for g in groups.values() for content, k in g.items()]


def bounded(price: np.ndarray, lengths: np.ndarray, left: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length the best configuration that holds it, no length more often than it is left: values, and counts by row."""
    weight, worth, owner, many = [], [], [], []
    for i, (l, n) in enumerate(zip(lengths.tolist(), np.minimum(left, size // lengths).tolist(), strict=True)):
        k = 1
        while n:
            k = min(k, n)
            weight.append(k * l)
            worth.append(k * price[i])
            owner.append(i)
            many.append(k)
            n -= k
            k *= 2
    best, took = np.zeros(size + 1), np.zeros((len(weight), size + 1), bool)
    for i, w in enumerate(weight):
        value = best[: size + 1 - w] + worth[i]
        better = value > best[w:] + 1e-12
        took[i, w:] = better
        best[w:][better] = value[better]
    cap = size - lengths
    counts = np.eye(len(lengths), dtype=np.int32)
    for i in range(len(weight) - 1, -1, -1):
        taken = took[i, cap]
        if taken.any():
            cap = cap - weight[i] * taken
            counts[:, owner[i]] += many[i] * taken
    each = np.arange(len(lengths))
    counts[each, each] = np.minimum(counts[each, each], left)  # the piece itself may be one too many
    return price + best[size - lengths], counts


def priced(left: np.ndarray, steps: int = AGAIN, heat: float = 0.02, rate: float = 0.3) -> np.ndarray:
    """Prices of the lengths that are left, by multiplicative weights over whole configurations."""
    size, lengths = len(left), np.flatnonzero(left) + 1
    n = left[lengths - 1].astype(np.int64)
    bins, price = float((n * lengths).sum() / size), lengths / size
    mean = np.zeros(len(lengths))
    for step in range(steps):
        value, counts = bounded(price, lengths, n, size)
        share = n * np.exp((value - value.max()) / heat)
        share *= bins / share.sum()
        price = price * np.exp(rate / np.sqrt(1 + step) * np.clip(1 - share @ counts / n, -1, 1))
        mean += price / steps
    return mean


def whole(left: np.ndarray, price: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """The best whole configurations for the longest pieces that are left, until one takes what another took."""
    size, lengths = len(left), np.flatnonzero(left) + 1
    n = left[lengths - 1].astype(np.int64)
    _, counts = bounded(price[lengths - 1], lengths, n, size)
    out, rest = [], n.copy()
    for j in range(len(lengths) - 1, -1, -1):
        used = np.flatnonzero(counts[j])
        times = int((rest[used] // counts[j, used]).min())
        if not times:
            if rest[j]:
                break
            continue
        rest[used] -= times * counts[j, used]
        out.append(({int(lengths[i]): int(counts[j, i]) for i in used.tolist()}, times))
    return out


def rounded(need: np.ndarray) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole configurations from the program, solved again over what is left, and the last pieces (at most REST of all)."""
    left, out = need.astype(np.int64).copy(), []
    last, length = int(REST * left.sum()), np.arange(1, len(left) + 1) / len(left)

    def take(configs):
        for config, times in configs:
            times = min(times, *(int(left[l - 1]) // m for l, m in config.items()))
            if times > 0:
                out.append((config, times))
                for l, m in config.items():
                    left[l - 1] -= times * m

    take([(c, int(x)) for c, x in fractional(left)] if left.any() else [])
    while left.sum() > last:
        price, goal = np.zeros(len(left)), max(int(left.sum()) // 2, last)
        price[np.flatnonzero(left)] = priced(left)
        # Fullness counts beside the program's prices, and long pieces a little more: short ones fill the last gaps.
        price = price / 2 + length * (1 + 0.02 * length)
        while left.sum() > goal:
            take(whole(left, price))
    return out, left


def plan(need: np.ndarray) -> list[tuple[dict[int, int], int]]:
    """Configurations and how often each is used; they cover the histogram exactly."""
    short, out = need.astype(np.int64).copy(), []
    if short[-1]:
        out.append(({len(need): 1}, int(short[-1])))
        short[-1] = 0
    configs, left = rounded(short)
    return out + min(configs + best_fit(left), best_fit(short), key=lambda plan: sum(k for _, k in plan))


def places(configs: list[tuple[dict[int, int], int]], size: int) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first ranks, first bins, pieces in a bin and offsets there."""
    ranks, bins = Counter(), 0
    out: dict[int, list] = {}
    for config, times in configs:
        offset = 0
        for length, each in config.items():
            out.setdefault(length, []).append((ranks[length], bins, each, offset))
            ranks[length] += times * each
            offset += length * each
        bins += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items()}


def pieces_of(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each document's pieces with the input partition and the rank among its pieces of equal length. with_ids: and the ids, little-endian."""

    def run(batches):
        encoder, part, seen = Encoder.of(tokenizer, False), TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch in batches:
            ids, bounds = encoder.batch(batch.column(1))
            n = np.diff(bounds) + 1
            flat = np.insert(ids, bounds[1:], end_id).astype("<u4")
            count = -(-n // length)
            doc = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            head = n - length * (count - 1)
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * length)
            size = np.where(piece == 0, head[doc], length)
            order = np.argsort(size, kind="stable")
            first = np.flatnonzero(np.diff(size[order], prepend=-1)) if len(order) else order
            times = np.diff(np.append(first, len(order)))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order)) - np.repeat(first, times)
            rank += seen[size]
            seen += np.bincount(size, minlength=length + 1)
            base = np.concatenate([[0], np.cumsum(n)])[doc] + start
            raw = memoryview(flat.tobytes())
            parts = [raw[4 * a : 4 * (a + k)] for a, k in zip(base.tolist(), size.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(map(zlib.crc32, parts), pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank, pa.int64())]
            names = [f.split()[0] for f in PIECES.split(", ")]
            if with_ids:
                columns.append(pa.array(map(bytes, parts), pa.binary()))
                names.append("ids")
            yield pa.record_batch(columns, names)

    tune(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, tokenizer: str, length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of each piece (and ids)."""
    pieces = stage(pieces_of(docs, tokenizer, length, end_id, id_col, text_col, with_ids), "pieces").df
    sizes = stage(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "piece-counts").df
    need = np.zeros(length, np.int64)
    for row in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `length` rows
        need[row["length"] - 1] = row["n"]
    table = places(plan(need), length)
    window = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col("part").alias("_part"), F.col("length").alias("_length"), F.coalesce(F.sum("n").over(window), F.lit(0)).alias("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    ranked = pieces.join(before, (pieces.part == before._part) & (pieces.length == before._length)).select(*columns, (F.col("before") + F.col("rank")).alias("rank"))

    def assign(batches):
        for batch in batches:
            size, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            cuts = np.flatnonzero(np.diff(size[order], prepend=-1)) if len(order) else order
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                at = order[a:b]
                ranks, bins, each, offsets = table[int(size[at[0]])]
                k = np.searchsorted(ranks, rank[at], "right") - 1
                own = rank[at] - ranks[k]
                sequence[at] = bins[k] + own // each[k]
                offset[at] = offsets[k] + own % each[k] * size[at]
            yield pa.record_batch([*(batch.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    return ranked.mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long")
