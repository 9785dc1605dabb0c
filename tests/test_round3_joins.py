"""Joins whose sides were judged by the size of a file, or that carried a text for each of its words."""

import re

from folioweave.operators import extract, resolve
from folioweave.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_document_edges_broadcast_nothing(spark):
    assert "BroadcastHashJoin" not in plan(QUERIES["document_edges"](spark, FOLDER))


def test_evidence_may_begin_and_end_within_words(spark):
    texts = {1: "the  quick\nbrown fox jumps", 2: "lathe quick brown foxes", 3: "quick brown fox", 4: None, 5: "abcdefghijklmnopqrstuvwxyz"}
    items = {"a": "the quick brown fox", "b": "cdefghijklmnopqrstu", "c": "brown fox", "d": None}
    got = resolve.evidenced(spark.createDataFrame(list(items.items()), "item_id string, evidence string"), spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == [("a", 1), ("a", 2), ("b", 5)]


def test_words_of_a_body_move_without_it(spark):
    rows = [(1, 1, "definition", "A normal form $x$ is given."), (1, 2, "lemma", "It has a normal form."), (1, 3, "lemma", "It has none.")]
    out = extract.operator_edges(spark.createDataFrame(rows, "doc long, n int, kind string, body string"))
    carried = re.findall(r"\), \[([^\]]*)\], false, \[part", plan(out))
    assert carried and not any("body" in c for c in carried)
    assert [tuple(r) for r in out.collect()] == [(1, 2, 1, "depends_on", 0.85)]
