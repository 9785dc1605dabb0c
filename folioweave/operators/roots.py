"""Where a trace begins (GRF-01, GRF-02): nodes that a selected text names, is part of, or refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as S


def _normal(column: str):
    return S.squeezed(F.lower(column))


def named_roots(nodes: DataFrame, requests: DataFrame) -> DataFrame:
    """GRF-01: (request, id): for each label or title that the selection mentions its nodes on the request's page, else all; if they are one identity, the first of them.

    nodes: doc, id, page, entity, label, title; requests: request, doc, page, selection.
    """
    names = nodes.select("doc", "id", "page", F.coalesce(F.col("entity").cast("string"), F.col("id").cast("string")).alias("identity"), F.explode(F.array_distinct(F.filter(F.array(_normal("label"), _normal("title")), lambda x: x.isNotNull() & (x != "")))).alias("name"))
    asked = requests.select("request", "doc", F.col("page").alias("at"), _normal("selection").alias("selection"))
    found = names.join(asked, "doc").where(F.expr("instr(selection, name) > 0")).where(S.mentioned(F.col("selection"), F.col("name")))
    here = F.coalesce(F.col("page") == F.col("at"), F.lit(False))
    one = lambda c: [F.countDistinct(F.when(c, F.col("identity"))), F.min(F.when(c, F.struct("page", "id")))]
    on, all_ = one(here), one(F.lit(True))
    picked = found.groupBy("request", "name").agg(on[0].alias("n1"), on[1].alias("f1"), all_[0].alias("n2"), all_[1].alias("f2"))
    first = F.when(F.col("n1") == 1, F.col("f1")).when((F.col("n1") == 0) & (F.col("n2") == 1), F.col("f2"))
    return picked.select("request", first["id"].alias("id")).where("id IS NOT NULL").distinct()


def passage_roots(nodes: DataFrame, requests: DataFrame, characters: int = 24, words: int = 4) -> DataFrame:
    """GRF-02: the only node of the page whose statement holds the selection, if that is long enough."""
    asked = requests.select("request", "doc", F.col("page").alias("at"), _normal("selection").alias("selection")).where((F.length("selection") >= characters) & (F.size(F.split("selection", " ")) >= words))
    found = nodes.select("doc", "id", "page", _normal("statement").alias("s")).join(asked, "doc").where(F.col("at").isNull() | (F.col("page") == F.col("at"))).where(F.contains("s", "selection"))
    return found.groupBy("request").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").select("request", "id")


def anchor_roots(anchors: DataFrame, requests: DataFrame) -> DataFrame:
    """GRF-02: the first target of each surface in the selection that stands for one identity. anchors: doc, page, surface, target, identity."""
    asked = requests.select("request", "doc", F.col("page").alias("at"), _normal("selection").alias("selection"))
    a = anchors.where("target IS NOT NULL").select("doc", "page", _normal("surface").alias("s"), "target", "identity").where("s <> ''")
    found = a.join(asked, "doc").where(F.col("at").isNull() | (F.col("page") == F.col("at"))).where(F.expr("instr(selection, s) > 0")).where(S.mentioned(F.col("selection"), F.col("s")))
    return found.groupBy("request", "s").agg(F.countDistinct("identity").alias("n"), F.min("target").alias("id")).where("n = 1").select("request", "id").distinct()
