"""Vectors between blocks of nodes: what moves, where it goes, and what is kept of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioweave.llm import ann


def test_a_block_asks_for_a_vector_once():
    """However many of its nodes have it as a member."""
    rng, blocks = np.random.default_rng(21), 6
    u, w = np.repeat(np.arange(600), 28), rng.integers(0, 600, 600 * 28)
    lists = ann._lists(*ann._top(u, w, rng.random(len(u)), np.ones(len(u), bool), 28))
    sent = list(ann._send_neighbours(blocks)([lists]))
    for block in range(blocks):
        mine = [p.filter(p["block"].to_numpy() == block) for p in sent]
        out = list(ann._members(blocks, 1)(mine))
        asked = np.concatenate([p["a"].flatten().to_numpy() for p in out if p["kind"][0].as_py() == ann.ASKED])
        members = np.concatenate([p["b"].flatten().to_numpy() for p in out if p["kind"][0].as_py() == ann.MEMBERS])
        assert sorted(asked.tolist()) == sorted(set(members.tolist()))
        assert len(members) > 5 * len(asked)


@pytest.mark.parametrize("blocks", [1, 7, 560])
def test_homes_are_even_whatever_the_step_of_ids(blocks):
    for step in (1, 100, 560, 2147483647, 2147483629, 1 << 40):
        n = np.bincount(ann._home((np.arange(8000) - 4000) * step, blocks), minlength=blocks)
        assert n.sum() == 8000 and n.max() <= 3 * 8000 / blocks + 12


@pytest.mark.parametrize("ids", [np.arange(9), np.arange(9) * (1 << 59), np.arange(9) - 4])
def test_top_is_that_of_a_plain_sort(ids):
    rng = np.random.default_rng(22)
    u, w = ids[rng.integers(0, 9, 400)], ids[rng.integers(0, 9, 400)]
    d, new = rng.integers(0, 4, 400).astype(float), rng.random(400) < 0.5
    want = []
    for one in sorted(set(u.tolist())):
        near = {other: (d[(u == one) & (w == other)].min(), other, bool(new[(u == one) & (w == other)].all())) for other in w[u == one].tolist()}
        want += [(one, b, a, c) for a, b, c in sorted(near.values())[:5]]
    assert list(zip(*(c.tolist() for c in ann._top(u, w, d, new, 5)), strict=True)) == want


@pytest.mark.parametrize("held", [1 << 12, 1 << 16])
def test_many_blocks_give_the_same_quality(spark, monkeypatch, held):
    """Negative and far ids, more blocks than cores, entries in several goes."""
    monkeypatch.setattr(ann, "HELD", held)
    monkeypatch.setattr(ann, "GATHERED", 3000)
    x = np.random.default_rng(23).normal(size=(700, 16))
    ids = (np.arange(700) - 350) * (1 << 52)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % (7 << 52) == 0, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    asked = [i for i in range(700) if ids[i] % (7 << 52) == 0]
    for i in asked:
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(got[int(ids[i])] & set(ids[np.argsort(d)[:10]].tolist()))
    assert len(got) == len(asked) and hits >= 9.5 * len(asked)


def test_block_count_follows_memory(spark):
    df, least = spark.range(1), max(6, spark.sparkContext.defaultParallelism)
    assert ann.block_count(df, 1000, 256, 28) == least
    fit = ann.HELD // 256
    counts = [ann.block_count(df, n * fit, 256, 28) for n in (2, 20, 200)]
    # What a block needs fits; blocks grow in number with the nodes.
    for n, blocks in zip((2, 20, 200), counts, strict=True):
        assert n * fit * -np.expm1(-48 / blocks) <= fit * 1.01
    assert counts[2] < 10.5 * counts[1]
