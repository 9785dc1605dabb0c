"""Ranks and traces move what changes, not the edges."""

from folioweave.operators import graph
from folioweave.plans import adapters
from folioweave.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_stay_while_scores_move(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(graph, "CHUNK", 4)
    monkeypatch.setattr(graph, "PACK", 5)
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 30, (80, 2))] + [(1, 99)]
    nodes, edges = spark.range(27), spark.createDataFrame(pairs, "src long, dst long")
    inside = [(a, b) for a, b in pairs if a < 27 and b < 27]
    out, score = np.bincount([a for a, _ in inside], minlength=27), np.full(27, 1 / 27)
    for _ in range(5):
        share = np.divide(score, out, out=np.zeros(27), where=out > 0)
        score = (0.15 + 0.85 * score[out == 0].sum()) / 27 + 0.85 * np.bincount([b for _, b in inside], share[[a for a, _ in inside]], 27)
    got = {r["id"]: r["score"] for r in graph.pagerank(nodes, edges, rounds=5).collect()}
    assert np.allclose([got[i] for i in range(27)], score, rtol=0, atol=1e-12)
    cells = graph.Cells(edges.toDF("a", "b"), graph.numbered(nodes), 27, len(pairs))
    assert cells.degrees().count() > 0
    shares = spark.createDataFrame([(0, bytearray(np.ones(4).tobytes()))], "c int, share binary")
    assert plan(cells.sums(shares)).count("ENSURE_REQUIREMENTS") == 1
    cells.close()


def test_only_edges_of_the_parents_are_ranked(spark, monkeypatch):
    seen, rank = [], graph.strongest
    monkeypatch.setattr(graph, "strongest", lambda edges, *more: (seen.append(edges.count()), rank(edges, *more))[1])
    edges = spark.createDataFrame([(a, a + b, 0.5) for a in range(100) for b in (1, 2)], "src long, dst long, confidence double")
    out = graph.trace_bfs(edges, spark.createDataFrame([(1, 7)], "request long, id long"), depth=2)
    assert sorted((r["node"], r["depth"]) for r in out.collect()) == [(7, 0), (8, 1), (9, 1), (10, 2), (11, 2)]
    assert seen == [2, 4]


def test_edges_are_dealt_by_the_end_that_ranks(spark):
    assert "ENSURE_REQUIREMENTS" not in plan(graph.dependents(adapters.edges(Tables(spark, FOLDER), "dst"))).split("HashAggregate")[0]
