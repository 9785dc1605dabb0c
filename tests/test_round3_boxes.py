"""Boxes: no table of tiles is broadcast, few boxes are one tile, copies are asked for once."""

from pyspark.sql import functions as F

from folioweave.operators import relational, spatial

BOXES = "id long, doc long, page long, x0 int, y0 int, x1 int, y1 int, name string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_table_of_tiles_is_broadcast(spark, tmp_path):
    path = f"file://{tmp_path}/boxes"
    spark.createDataFrame([(i, 0, 0, i, i, i + 20, i + 20, "n") for i in range(200)], BOXES).write.parquet(path)
    df = spark.read.parquet(path)
    for preset in relational.PRESETS:
        assert "BroadcastHashJoin" not in plan(relational.owners(df, df, preset))


def test_boxes_meet_once_for_the_projection(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, 0, 9, 9, "n")], BOXES)
    assert plan(relational.owners(df, df, "projection")).count("SortMergeJoin") == plan(relational.owners(df, df, "edges")).count("SortMergeJoin")


def test_copies_of_a_box_are_asked_for_once(spark):
    rows = [(i, 0, 0, 0, 0, 50, 50, "n") for i in range(40)] + [(100, 0, 0, 10, 10, 20, 20, "n"), (None, 0, 0, 0, 0, 50, 50, "n")]
    df = spark.createDataFrame(rows, BOXES)
    assert sorted((r["id"] for r in relational.outermost(df, "name").collect()), key=str) == [0, None]
    inner = [df.where("id IS NOT NULL").groupBy("doc", "page", "name", *spatial.BOX).agg(F.min("id"))]
    assert inner[0].count() == 2


def test_outermost_meets_all_boxes_of_a_hundred_documents(spark):
    from folioweave.plans import adapters
    from folioweave.plans.registry import SQL, Tables

    assert "p_partkey % 100 AS doc, p_size % 5 + 1 AS page" in SQL["outermost_anchors"]
    assert adapters.crowded(Tables(spark, "/root/testdata/sf0.1")).select("doc", "page").distinct().count() == 500
