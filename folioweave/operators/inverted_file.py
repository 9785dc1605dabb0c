"""Approximate cosine neighbours by an inverted file (RET-03, JN-17).

Unit vectors are dealt to the nearest of some trained centroids; within a scope
(a corpus, say) each centroid has one list. What is left of a vector beside its
centroid is product-quantised: cut into parts, each named by the nearest of 256
trained codewords, so a list holds a few bytes a vector. A query looks into the
lists of the nearest centroids of its scope, scores the codes from one table of
products for each part, and the best candidates are scored again on the vectors
themselves.

Centroids and codewords are fitted on SAMPLE vectors at most (the documented
bound of what the driver sees); all vectors are listed. Lists are cut into pieces
of PIECE vectors, so a list that holds a third of all is many tasks. How many
lists a query looks into is found by measuring: it doubles until a sample of
queries, answered exactly, reaches the wanted recall; with all lists and all
candidates the answer is exact.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tables
from .relational import small
from .retrieval import nearest, ranked

SAMPLE, MOST_LISTS, PARTS, WORDS = 20_000, 4096, 8, 256
PIECE, ASKED, ROUNDS = 50_000, 64, 12
#: Queries whose lists are found at a time, queries of a scope that one task holds for a piece, and values of either side at most.
PROBES, BLOCK, VALUES = 4096, 20_000, 1 << 22


@dataclass
class Book:
    centroids: np.ndarray
    words: np.ndarray  # part, word, values


@dataclass
class Found:
    hits: DataFrame
    recall: float
    lists: int
    candidates: int


def _unit(column: pa.ChunkedArray | pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the rows that have a direction and the width."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
    width = width or int(size.max(initial=0))
    same = size == width
    rows = flat[np.repeat(same, size)].reshape(-1, width) if width else np.zeros((0, 0))
    place = np.flatnonzero(same)
    with np.errstate(over="ignore", invalid="ignore"):
        top = np.abs(rows).max(1, initial=0)
        good = np.isfinite(top) & (top > 0)
        rows = rows[good] / top[good, None]
    return place[good], rows / np.sqrt((rows * rows).sum(1))[:, None]


def _means(x: np.ndarray, k: int, rng: np.random.Generator, directions: bool) -> np.ndarray:
    """k-means, by angle or by distance; a mean that nothing is near takes the point that is worst off."""
    means = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(ROUNDS):
        score = x @ means.T - (0 if directions else 0.5 * (means * means).sum(1))
        own = score.argmax(1)
        total = np.zeros_like(means)
        np.add.at(total, own, x)
        n = np.bincount(own, minlength=k)
        means = total / np.maximum(n, 1)[:, None]
        worst = np.argsort(score[np.arange(len(x)), own])[: (n == 0).sum()]
        means[np.flatnonzero(n == 0)[: len(worst)]] = x[worst]
        if directions:
            means /= np.maximum(np.sqrt((means * means).sum(1)), 1e-30)[:, None]
    return means


def fit(vectors: DataFrame, lists: int | None = None, seed: int = 7) -> Book | None:
    """Centroids (the root of the number of vectors, if not given) and codewords; vectors: id, v. None if none has a direction."""
    rows = vectors.where("v IS NOT NULL").select(F.xxhash64("id", F.lit(seed)).alias("h"), F.col("v").cast("array<double>").alias("v")).orderBy("h").limit(SAMPLE).toArrow()
    _, x = _unit(rows["v"])
    if not len(x):
        return None
    rng = np.random.default_rng(seed)
    k = lists or int(min(MOST_LISTS, max(1, vectors.count() ** 0.5)))
    centroids = _means(x, min(k, len(x)), rng, True)
    rest = x - centroids[(x @ centroids.T).argmax(1)]
    width = -(-x.shape[1] // PARTS)
    rest = np.pad(rest, ((0, 0), (0, width * PARTS - x.shape[1]))).reshape(len(x), PARTS, width)
    return Book(centroids, np.stack([_means(rest[:, m], min(WORDS, len(x)), rng, False) for m in range(PARTS)]))


def listed(vectors: DataFrame, book: Book, scope: str | None = None) -> DataFrame:
    """The inverted file: scope, list, id, code (a byte a part). Vectors without a direction or of another width are left out."""
    kept = vectors.select((F.col(scope) if scope else F.lit(1)).alias("scope"), "id", F.col("v").cast("array<double>").alias("v"))

    def run(batches):
        for batch in batches:
            place, x = _unit(batch.column(2), book.centroids.shape[1])
            own = (x @ book.centroids.T).argmax(1) if len(x) else np.zeros(0, np.int64)
            parts, _, width = book.words.shape
            rest = np.pad(x - book.centroids[own], ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)
            code = np.stack([(rest[:, m] @ w.T - 0.5 * (w * w).sum(1)).argmax(1) for m, w in enumerate(book.words)], 1).astype(np.uint8) if len(x) else np.zeros((0, parts), np.uint8)
            some = pa.array(place)
            yield pa.record_batch({"scope": batch.column(0).take(some), "list": pa.array(own, pa.int32()), "id": batch.column(1).take(some), "code": pa.FixedSizeBinaryArray.from_buffers(pa.binary(parts), len(x), [None, pa.py_buffer(code.tobytes())]).cast(pa.binary())})

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, f"scope {kinds['scope']}, list int, id {kinds['id']}, code binary")


def _met(file: DataFrame, queries: DataFrame, book: Book, lists: int, most: int, keep: int, scope: str | None) -> DataFrame:
    """(q, id, score): of each piece of a query's nearest lists the best `most` by their codes, of which the best `keep` stay, by the exact cosine where the file has vectors v, else by the codes.

    A query goes once to each piece that has lists of its own, and a row of the file once to each block of its scope's
    queries, so what moves does not grow with the lists or candidates of a query.
    """
    asked = queries.select((F.col(scope) if scope else F.lit(1)).alias("scope"), "q", F.col("v").cast("array<double>").alias("v"))
    kinds = dict(asked.dtypes) | {"id": dict(file.dtypes)["id"]}
    width, n_lists = book.centroids.shape[1], len(book.centroids)
    piece, block = (max(1, min(n, VALUES // width)) for n in (PIECE, BLOCK))
    # Lists side by side are one group, so many groups that a scope's share of one is a piece or so; one row a list.
    per_list = np.zeros(n_lists, np.int64)
    for r in file.groupBy("list").count().collect():
        per_list[r["list"]] = r["count"]
    largest = file.groupBy("scope").count().agg(F.max("count")).first()[0] or 0
    group = (np.cumsum(per_list) - per_list) * min(n_lists, -(-largest // piece)) // max(1, per_list.sum())
    near = min(lists, n_lists)

    def nearest_lists(x: np.ndarray) -> np.ndarray:
        return np.argpartition(-(x @ book.centroids.T), near - 1, 1)[:, :near]

    def probing(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PROBES):
                some = batch.slice(at, PROBES)
                place, x = _unit(some.column(2), width)
                pairs = np.unique(np.repeat(np.arange(len(x)), near) * n_lists + group[nearest_lists(x)].ravel()) if len(x) else np.zeros(0, np.int64)
                row = pa.array(place[pairs // n_lists])
                yield pa.record_batch({"scope": some.column(0).take(row), "q": some.column(1).take(row), "v": some.column(2).take(row), "group": pa.array(pairs % n_lists, pa.int32())})

    probes = asked.mapInArrow(probing, f"scope {kinds['scope']}, q {kinds['q']}, v array<double>, group int")
    of_list = F.element_at(F.lit(group.tolist()).cast("array<int>"), F.col("list") + 1).alias("group")
    # A group of a scope and those who ask it are dealt into pieces and blocks; each block meets each piece, so a task's memory is bounded on both sides.
    pieces = file.groupBy("scope", of_list).agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces"))
    blocks = asked.groupBy("scope").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    of = small(pieces.join(blocks, "scope"))
    dealt = lambda c, n: F.pmod(F.xxhash64(c, F.lit("deal")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Rows that Python made look as few as those that it read, so they are never left to be broadcast by their size.
    left = probes.hint("merge").join(of, ["scope", "group"]).withColumn("piece", every("pieces")).withColumn("block", dealt("q", "blocks")).drop("pieces", "blocks")
    right = file.select("*", of_list).hint("merge").join(of, ["scope", "group"]).withColumn("piece", dealt("id", "pieces")).withColumn("block", every("blocks")).drop("pieces", "blocks")

    def scored(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        if len(a) and len(b):
            # By list, then by id, so that equal scores are in order of ids.
            b = b.sort_by([("list", "ascending"), ("id", "ascending")])
            parts, _, size = book.words.shape
            codes = np.frombuffer(b"".join(b["code"].to_pylist()), np.uint8).reshape(-1, parts)
            begin = np.searchsorted(b["list"].to_numpy(), np.arange(n_lists + 1))
            order = pc.rank(b["id"], tiebreaker="first").to_numpy()
            own = _unit(b["v"], width)[1] if "v" in b.column_names else None
            for at in range(0, len(a), PROBES):
                _, x = _unit(a["v"].slice(at, PROBES), width)
                probed, base = nearest_lists(x), x @ book.centroids.T
                cut = np.pad(x, ((0, 0), (0, size * parts - width))).reshape(len(x), parts, size)
                for i in range(len(x)):
                    runs = [np.arange(begin[j], begin[j + 1]) for j in np.sort(probed[i]) if begin[j] < begin[j + 1]]
                    if not runs:
                        continue
                    best = np.concatenate(runs)
                    if own is None or len(best) > most:
                        score = np.repeat(base[i], np.diff(begin))[best]
                        for m in range(parts):
                            score += (book.words[m] @ cut[i, m])[codes[best, m]]
                        some = np.argpartition(-score, most - 1)[:most] if len(best) > most else slice(None)
                        best, score = best[some], score[some]
                    if own is not None:
                        score = (own[best] * x[i]).sum(1)
                    first = np.lexsort((order[best], -score))[:keep]
                    out.append((np.full(len(first), at + i), best[first], score[first]))
        q, i, s = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
        return pa.table({"q": a["q"].take(pa.array(q)), "id": b["id"].take(pa.array(i)), "score": pa.array(s)})

    keys = ["scope", "group", "piece", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(scored, f"q {kinds['q']}, id {kinds['id']}, score double")


def candidates(file: DataFrame, queries: DataFrame, book: Book, lists: int, most: int, scope: str | None = None) -> DataFrame:
    """(q, id): the best `most` of each query by their codes, from its nearest lists. queries: q, v and the scope."""
    return ranked(_met(file.drop("v"), queries, book, lists, most, most, scope), ["q"], most).select("q", "id")


def search(vectors: DataFrame, file: DataFrame, queries: DataFrame, book: Book, k: int, lists: int, most: int, scope: str | None = None) -> DataFrame:
    """(q, id, score, rank): the k nearest of each query's candidates by the exact cosine, ties by id; its own id is left out. Candidates' vectors never move to a query: each vector moves with its code, and k rows of a piece go on."""
    held = file.join(vectors.select("id", F.col("v").cast("array<double>").alias("v")).hint("merge"), "id")
    return ranked(_met(held, queries, book, lists, most + 1, k + 1, scope).where("q <> id"), ["q"], k)


def nearest_listed(vectors: DataFrame, queries: DataFrame, k: int = 8, scope: str | None = None, recall: float = 0.95, seed: int = 7) -> Found:
    """Neighbours of queries (q, v) among vectors (id, v; ids must be unique), with the recall that a sample of ASKED queries has against the exact answer.

    Null, zero and non-finite vectors, and those of another width than the widest of the sample, take no part. Where no
    number of lists reaches the recall (few or shapeless vectors), the exact search takes its place and the recall is 1.
    """
    book = fit(vectors, seed=seed)
    if book is None:
        return Found(nearest(vectors, queries, k, scope), 1.0, 0, 0)
    file = tables.saved(listed(vectors, book, scope), "inverted-file")
    asked = tables.saved(queries.orderBy(F.xxhash64("q", F.lit(seed))).limit(ASKED), "asked")
    wanted = {(r["q"], r["id"]) for r in nearest(vectors, asked, k, scope).select("q", "id").collect()}  # ASKED * k rows at most
    lists, most, had = max(1, len(book.centroids) // 32), 4 * k, 1.0
    while wanted:
        got = {(r["q"], r["id"]) for r in search(vectors, file, asked, book, k, lists, most, scope).select("q", "id").collect()}
        had = len(wanted & got) / len(wanted)
        if had >= recall:
            break
        if lists >= len(book.centroids) // 2 and most >= 256 * k:
            return Found(nearest(vectors, queries, k, scope), 1.0, 0, 0)
        lists, most = min(2 * lists, len(book.centroids)), 2 * most
    return Found(search(vectors, file, queries, book, k, lists, most, scope), had, lists, most)
