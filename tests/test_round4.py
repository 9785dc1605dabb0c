"""Findings of round 4: what is broadcast, what moves, and what a task holds."""

from types import SimpleNamespace

import numpy as np

from folioweave.operators import extract, inverted_file, tables
from folioweave.plans import retrieval


def broadcast(df):
    """The lines of the plan that are under a broadcast."""
    out, under = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        under = None if under is not None and at <= under else under
        if under is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            under = at
    return out


def test_probes_of_lists_are_never_broadcast(spark):
    """They look as few as the queries, which are a small file."""
    x = np.random.default_rng(5).normal(size=(400, 16))
    v = tables.saved(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>"))
    book = inverted_file.fit(v, lists=8)
    file = tables.saved(inverted_file.listed(v, book))
    hits = inverted_file.search(v, file, v.withColumnRenamed("id", "q"), book, 3, 8, 400)
    assert not [x for x in broadcast(hits) if "MapInArrow" in x or "CoGroup" in x]
    assert hits.count() == 1200


def moved(df):
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x and "REPARTITION_BY_NUM" not in x]


def test_rules_of_documents_move_no_statement_that_is_held(spark):
    """Joins by document and another key meet where the document is."""
    rows = [(d, n, "definition" if n % 4 == 0 else "lemma", f"A normal form $x$ is {n}." if n % 4 == 0 else "It has a normal form.") for d in range(20) for n in range(8)]
    nodes = spark.createDataFrame(rows, "doc long, n int, kind string, body string")
    want = sorted(map(tuple, extract.operator_edges(nodes).collect()))

    def build(keep):
        edges = extract.operator_edges(keep(nodes.repartition(3, "doc")).hint("merge"))
        assert not moved(edges)
        return edges

    assert sorted(map(tuple, tables.in_place(spark, build, "edges").collect())) == want and want
    assert moved(extract.operator_edges(nodes.repartition(3, "doc").hint("merge")))


def test_pairs_are_dealt_by_their_number_and_asked_for_by_names(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "PAIRS_A_TASK", 100)
    monkeypatch.setattr(retrieval, "PARTS_A_BLOCK", 1)
    rows = [(i, f"n{i % 3}" if i % 7 else None, "b", 1) for i in range(60)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int")
    got = retrieval.adjudicated(SimpleNamespace(spark=spark, part=part))
    assert got.rdd.getNumPartitions() >= 18
    want = [(a, b, "same" if x == y else "different") for a, x, _, _ in rows for b, y, _, _ in rows if a < b]
    assert sorted(map(tuple, got.collect())) == want
