"""Rows picked by bitmaps of their numbers."""

import pytest
from pyspark.sql import functions as F

from folioweave.llm import store


@pytest.mark.parametrize("bitmaps", [8192, 4, 1])
def test_picked_rows(spark, monkeypatch, bitmaps):
    """Also where ranges of numbers go one after the other, and at the ends of bitmaps and partitions."""
    monkeypatch.setattr(store, "BITMAPS", bitmaps)
    docs = spark.range(0, 100_000, 1, 3).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    rows = store.numbered(docs)
    marked = rows.where("doc.doc_id % 7 = 0 OR doc.doc_id IN (0, 1, 32766, 32767, 32768, 33332, 33333, 33334, 66665, 66666, 66667, 99999)")
    want = {r["doc_id"] for r in marked.select("doc.doc_id").collect()}
    twice = marked.select("row").unionByName(marked.select("row").limit(50))
    assert sorted(r["doc_id"] for r in store.picked(rows, twice, keep=True).collect()) == sorted(want)
    assert sorted(r["doc_id"] for r in store.picked(rows, twice, keep=False).collect()) == sorted(set(range(100_000)) - want)
    assert store.picked(rows, marked.limit(0).select("row"), keep=True).isEmpty()


def test_nothing_to_pick_from(spark):
    rows = store.numbered(spark.createDataFrame([], "doc_id long, text string"))
    assert store.picked(rows, rows.select("row"), keep=True).isEmpty() and store.picked(rows, rows.select("row"), keep=False).columns == ["doc_id", "text"]


def test_texts_do_not_move(spark):
    rows = store.numbered(spark.createDataFrame([(i, "x" * i) for i in range(9)], "doc_id long, text string"))
    plan = store.picked(rows, rows.select("row").where("doc.doc_id > 3"), keep=False)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan
    assert plan.count("strategy=broadcast") == 1
