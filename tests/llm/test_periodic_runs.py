"""Runs against a brute force over all periods, on planted and random repeats."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from folioweave.llm import periodic_runs, queries

from .test_ops import WORD, by_id, docs, empty, rows  # noqa: F401


def brute(w):
    """(start, length, period) of all runs: maximal stretches of each period, of which the smallest counts."""
    out = {}
    for p in range(1, len(w) // 3 + 1):
        at = 0
        for i in range(p, len(w) + 1):
            if i == len(w) or w[i] != w[i - p]:
                if i - at >= max(24, 3 * p):
                    out.setdefault((at, i - at), p)
                at = i - p + 1
    return sorted((s, n, p) for (s, n), p in out.items())


def planted(i, t):
    w = WORD.findall(t or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    n, g = len(w), h // 10
    if h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]


def digest(w):
    runs = brute(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {j for s, n, p in runs for j in range(s + p, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone)))


def periodic(rng):
    """Words of few kinds, with repeats of repeats."""
    w = []
    while len(w) < rng.choice((10, 60, 300, 900)):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 30))]
        if rng.random() < 0.4:
            unit = (unit[:4] * 9)[: rng.randint(4, 36)] + unit
        w += (unit * 12)[: rng.randint(1, 12 * len(unit))]
    return w


def found(documents):
    numbers = {}
    flat = np.array([numbers.setdefault(x, len(numbers)) for w in documents for x in w], np.int32)
    out = [[] for _ in documents]
    for d, *r in zip(*(x.tolist() for x in periodic_runs.runs_of(flat, np.array([len(w) for w in documents]))), strict=True):
        out[d].append(tuple(r))
    return out


@pytest.mark.parametrize("seed", range(12))
def test_all_runs(seed, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PLACES", (1 << 20, 50)[seed % 2])
    rng = random.Random(seed)
    documents = [periodic(rng) for _ in range(25)] + [["a"] * n for n in (1, 23, 24, 25, 200)] + [list("ab" * 12), list("ab" * 11 + "a"), list("abcdefgh" * 3), list("abcdefghi" * 3)[:26]]
    assert found(documents) == [brute(w) for w in documents]


def test_queries_rows(spark, docs, rows, tmp_path):  # noqa: F811
    """Nulls, empty texts, repeated rows, columns of clashing names; every tenth document repeats its words."""
    rng = random.Random(5)
    more = [(1000 + i, "\n ".join(periodic(rng))) for i in range(150)] + [(3000 + i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(0, 400)))) for i in range(150)]
    data = [*rows, *more]
    extra = spark.createDataFrame([(i, t, "x", -1, "y") for i, t in data], docs.schema)
    extra.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(queries.op12_periodic_runs(spark, str(tmp_path)))
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert {i: tuple(r[n] for n in names) for i, r in got.items()} == {i: digest(planted(i, t)) for i, t in data}
    assert sum(r["n_runs"] > 0 for r in got.values()) > 60


def test_defined_results(spark):
    t = " ".join(["x y"] * 20)
    df = spark.createDataFrame([(None, t, 1), (None, t, 2), (1, None, 3), (2, " \n", 4), (3, f"a {t} b", 5)], "doc_id long, text string, runs int")
    got = sorted(tuple(r) for r in periodic_runs.periodic_runs(df).selectExpr("coalesce(doc_id, -1)", "n_words", "size(runs)", "strongest.start", "collapsed").collect())
    assert got == [(-1, 40, 1, 0, "x y"), (-1, 40, 1, 0, "x y"), (1, 0, 0, None, ""), (2, 0, 0, None, ""), (3, 42, 1, 1, "a x y b")]
    assert [r["text"] for r in periodic_runs.echoed(df).where("doc_id IS NULL").collect()] == [t, t]
    assert periodic_runs.periodic_runs(empty(spark)).isEmpty()


def test_very_long_texts(spark):
    rng = random.Random(9)
    unit = [f"u{i}" for i in range(70_000)]
    plain = [f"v{rng.randrange(9)}" for _ in range(300_000)]
    df = spark.createDataFrame([(1, " ".join(unit * 4)), (2, "a " * 500_000), (3, " ".join(plain))], "doc_id long, text string")
    got = by_id(periodic_runs.periodic_runs(df))
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 280_000, 70_000)] and got[1]["collapsed"] == " ".join(unit)
    assert [tuple(r) for r in got[2]["runs"]] == [(0, 500_000, 1)]
    assert got[3]["runs"] == []


def test_exact_ratios():
    """Ratios that floats can't tell apart."""
    n = 3 * 10**15
    start, length, period = np.array([5, 9]), np.array([n, n + 1]), np.array([10**15, 10**15])
    assert periodic_runs.strongest(start, length, period) == 1
    assert periodic_runs.strongest(np.array([9, 5]), np.array([30, 60]), np.array([10, 20])) == 1
