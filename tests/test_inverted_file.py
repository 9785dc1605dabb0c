"""Neighbours from the inverted file against all pairs."""

import numpy as np
import pytest

from folioweave.operators import inverted_file as I


def clustered(n, d=16, kinds=40, seed=1):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(kinds, d))
    return centre[rng.integers(0, kinds, n)] + 0.35 * rng.normal(size=(n, d))


def frame(spark, x, more=()):
    rows = [(i, v.tolist() if v is not None else None, "ab"[i % 3 == 0]) for i, v in enumerate(x)]
    return spark.createDataFrame([*rows, *more], "id long, v array<double>, corpus string").repartition(4)


def exact(x, k, groups):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for i in range(len(x)):
        score = u @ u[i]
        score[[j for j in range(len(x)) if groups[j] != groups[i] or j == i]] = -9
        out[i] = set(np.argsort(-score)[:k].tolist())
    return out


def test_recall_is_measured_and_reached(spark):
    x = clustered(3000)
    v = frame(spark, x)
    found = I.nearest_listed(v, v.withColumnRenamed("id", "q"), 8, "corpus")
    rows = found.hits.collect()
    want = exact(x, 8, [i % 3 == 0 for i in range(len(x))])
    hit = sum(r["id"] in want[r["q"]] for r in rows) / (8 * len(x))
    assert found.recall >= 0.95 and hit >= 0.94
    assert 0 < found.lists < 54 // 2  # not all lists
    assert all((r["q"] % 3 == 0) == (r["id"] % 3 == 0) and r["q"] != r["id"] for r in rows)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert all(abs(r["score"] - u[r["q"]] @ u[r["id"]]) < 1e-12 for r in rows)


def test_all_lists_and_candidates_are_exact(spark):
    x = np.random.default_rng(3).normal(size=(300, 10))
    v = frame(spark, x)
    book = I.fit(v)
    hits = I.search(v, I.listed(v, book), v.withColumnRenamed("id", "q"), book, 5, len(book.centroids), 300)
    want = exact(x, 5, [0] * 300)
    got = {}
    for r in hits.collect():
        got.setdefault(r["q"], set()).add(r["id"])
    assert got == want


def test_lists_go_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(I, "PIECE", 7)
    x = clustered(200, kinds=2)
    v = frame(spark, x)
    book = I.fit(v, lists=2)
    hits = I.search(v, I.listed(v, book, "corpus"), v.withColumnRenamed("id", "q"), book, 4, 2, 200, "corpus").collect()
    want = exact(x, 4, [i % 3 == 0 for i in range(200)])
    assert len(hits) == 800 and all(r["id"] in want[r["q"]] for r in hits)


def test_vectors_without_direction_take_no_part(spark):
    x = list(clustered(60, d=8))
    odd = [(100, None, "a"), (101, [0.0] * 8, "a"), (102, [1.0] * 7 + [float("nan")], "a"), (103, [1.0, None] * 4, "a"), (104, [1.0], "a"), (105, [1e200] * 8, "a")]
    v = frame(spark, x, odd)
    book = I.fit(v)
    ids = {r["id"] for r in I.listed(v, book).collect()}
    assert ids == set(range(60)) | {105}


@pytest.mark.parametrize("n", [0, 1])
def test_few(spark, n):
    v = frame(spark, clustered(2)[:n])
    found = I.nearest_listed(v, v.withColumnRenamed("id", "q"), 3)
    assert found.hits.isEmpty() and found.recall == 1.0
