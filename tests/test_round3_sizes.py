"""Steps whose cost grew faster than their input."""

import pyarrow as pa

from folioweave.operators import aggregates, extract, graph, inverted_file, layout, ledger
from folioweave.plans import adapters
from folioweave.plans.registry import QUERIES, Tables

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_prices_go_to_the_calls(spark):
    calls = spark.createDataFrame([("A", 10, 1, 1, 1), ("B", 1, 1, 1, 1)], "model string, total long, cached long, writes long, output long")
    prices = spark.createDataFrame([("A", 1.0, 1.0, 1.0, 1.0, None)], "model string, p_input double, p_cached double, p_write double, p_output double, most_input long")
    out = ledger.priced(calls.repartition(3), prices)
    assert "BroadcastHashJoin" in plan(out) and sorted((r["model"], r["why"]) for r in out.collect()) == [("A", None), ("B", "unknown model")]


def test_many_keys_are_one_pass_of_a_task(spark):
    df = spark.createDataFrame([(k, i, 5) for k in (1, 2, None) for i in range(7)], "k int, i int, size int").repartition(5)
    out = aggregates.greedy_batches(df, "k", "i", "size", 3, 12)
    assert "FlatMapGroups" not in plan(out)
    assert sorted(map(tuple, out.select("k", "i", "batch").where("k IS NOT NULL").collect())) == sorted((k, i, i // 2) for k in (1, 2) for i in range(7))
    assert sorted(r["batch"] for r in out.where("k IS NULL").collect()) == [i // 2 for i in range(7)]


def test_documents_are_admitted_in_one_pass_of_a_task(spark):
    edges = [(d, 1, p, a, b, "depends_on") for d in (1, 2, None) for p, (a, b) in enumerate([(1, 2), (2, 3), (3, 1), (1, 2)])]
    out = extract.acyclic(spark.createDataFrame(edges, "doc int, phase int, place int, src int, dst int, kind string").repartition(4))
    assert "FlatMapGroups" not in plan(out)
    assert sorted(map(str, (tuple(r) for r in out.select("doc", "src", "dst").collect()))) == sorted(map(str, ((d, a, b) for d in (1, 2, None) for a, b in ((1, 2), (2, 3)))))


def test_files_are_dealt_before_they_are_made_and_leave_in_batches(spark):
    from folioweave.sources import pdf

    files = spark.createDataFrame([(str(i), bytearray(b"no file")) for i in range(2500)], "path string, content binary").coalesce(1)
    sizes = pdf.pages(files).mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert sum(r["n"] for r in sizes) == 2500 and len(sizes) < 20
    assert QUERIES["pdf_runs"](spark, FOLDER).count() > 0


def test_one_timer_for_the_events_of_a_batch():
    import pandas as pd

    from folioweave.streaming import feeds

    timers, calls = [], []

    class Waiting:
        def appendList(self, rows):
            calls.append(rows)

    ledger_ = feeds.Spending(100, 0)
    ledger_.handle = type("Handle", (), {"registerTimer": staticmethod(timers.append)})
    ledger_.waiting = Waiting()
    list(ledger_.handleInputRows((1,), iter([pd.DataFrame({"at": [9, 5, 7], "id": [1, 1, 2], "kind": ["reserve"] * 3, "amount": [1, 2, 3]})]), None))
    assert timers == [5] and len(calls) == 1


def test_probes_leave_in_pieces(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(600)], "id long, v array<double>").coalesce(1)
    book = inverted_file.fit(v, lists=20)
    before = inverted_file.PROBES, inverted_file.BLOCK
    asked = v.withColumnRenamed("id", "q")
    want = sorted(map(tuple, inverted_file.candidates(inverted_file.listed(v, book), asked, book, 20, 600).collect()))
    try:
        inverted_file.PROBES, inverted_file.BLOCK = 50, 100
        got = sorted(map(tuple, inverted_file.candidates(inverted_file.listed(v, book), asked, book, 20, 600).collect()))
    finally:
        inverted_file.PROBES, inverted_file.BLOCK = before
    assert got == want and len(got) == 600 * 600


def test_only_nodes_that_may_touch_are_compared():
    import numpy as np

    rng = np.random.default_rng(2)
    points = rng.random((900, 2)) * 3000
    i, j = layout.beside(points, 512, 900, 28.0)
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    near = {(a, b) for a, b in zip(*np.nonzero(far < 28.0), strict=True) if a != b and a >= 512}
    assert near <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(i) < 900 * 388 // 20


def test_tasks_of_the_edges_grow_with_the_lines(spark, monkeypatch):
    t = Tables(spark, FOLDER)
    want = sorted(map(tuple, adapters.edges(t).collect()))
    monkeypatch.setattr(adapters, "LINES_A_TASK", 50)
    df = adapters.edges(t)
    assert "SortMergeJoin" not in plan(df) and f", {-(-t.lineitem.count() // 50)})" in plan(df)
    assert sorted(map(tuple, df.collect())) == want


def test_simple_edges_are_not_collapsed_again(spark):
    edges = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9)], "src long, dst long, confidence double")
    assert "HashAggregate" not in plan(graph.strongest(edges, 1, simple=True))
    assert sorted(map(tuple, graph.strongest(edges, 1, simple=True).collect())) == sorted(map(tuple, graph.strongest(edges, 1).collect()))


def test_maps_are_tasks_of_their_own(spark):
    nodes = spark.createDataFrame([(c, i) for c in range(9) for i in range(4)], "corpus int, id int")
    out = layout.layout(nodes, spark.createDataFrame([(0, 1, 0)], "corpus int, src int, dst int"))
    assert out.rdd.getNumPartitions() == 36 and out.count() == 36
