"""Statements are dealt by document before texts are made, and nothing with a text moves after that."""

import re

from folioweave.operators import extract
from folioweave.plans import extract as queries
from folioweave.plans.registry import QUERIES, Tables

FOLDER = "/root/testdata/sf0.001"


def moved(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)#", df._jdf.queryExecution().executedPlan().toString())


def test_environments_move_numbers_only(spark):
    nodes = extract.environments(extract.page_lines(queries._runs(Tables(spark, FOLDER))))
    assert moved(nodes) == ["doc", "l_orderkey"]


def test_anchor_boxes_move_numbers_only(spark):
    """Once for the runs, once for the labels."""
    assert moved(QUERIES["anchor_boxes"](spark, FOLDER)) == ["doc", "l_orderkey"] * 2
