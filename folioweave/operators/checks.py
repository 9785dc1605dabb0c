"""Integrity of a whole graph and comparability of measured runs, as rows of what is wrong (DQ-01, DQ-05).

A table is read once for all of its rules: each row becomes the short list of its
broken conditions and of the keys that it names. All keys that tables define are
one set, all named ones one table; they meet in one join, whatever the number of
foreign keys, and a key that a third of the rows names is split like any skewed one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOUND = "array<struct<rule:string,target:string,key:string,page:int,bad:boolean>>"


def _entry(rule: str, target: str | None = None, key: Column | None = None, page: Column | None = None, bad: Column | None = None) -> Column:
    none = lambda x, kind: (x if x is not None else F.lit(None)).cast(kind)
    return F.struct(F.lit(rule).alias("rule"), F.lit(target).cast("string").alias("target"), none(key, "string").alias("key"), none(page, "int").alias("page"), F.coalesce(none(bad, "boolean"), F.lit(False)).alias("bad"))


def _said(rows: DataFrame, table: str, id_: Column, entries: list[Column]) -> DataFrame:
    """A row for each broken condition and each key that is named; a null key names nothing."""
    kept = F.filter(F.array(*entries).cast(FOUND), lambda e: e["bad"] | e["key"].isNotNull())
    return rows.select(F.lit(table).alias("table"), id_.cast("string").alias("id"), F.explode(kept).alias("e")).select("table", "id", "e.*")


def graph_problems(t: dict[str, DataFrame], corpus: str) -> DataFrame:
    """DQ-01: (table, id, rule) of every rule that a row breaks; one row for each rule and row, also where rows repeat.

    documents: id, corpus_id, page_count, stored (whether its file is there); nodes: id, doc_id, entity_id, page; edges: src,
    dst (their id is `src>dst`); anchors: id, doc_id, target_node_id, target_entity_id, card_id; cards: id, anchor_id,
    doc_id; entities: id, canonical_node_id. A page count of 0 or null bounds no page.
    """
    c = F.col
    said = [
        _said(t["documents"], "documents", c("id"), [_entry("corpus", bad=~c("corpus_id").eqNullSafe(F.lit(corpus))), _entry("file", bad=~F.coalesce("stored", F.lit(False)))]),
        _said(t["nodes"], "nodes", c("id"), [_entry("doc", "documents", F.coalesce(c("doc_id").cast("string"), F.lit(""))), _entry("entity", "entities", c("entity_id")), _entry("page", "documents", c("doc_id"), c("page"))]),
        _said(t["edges"], "edges", F.concat_ws(">", "src", "dst"), [_entry("src", "nodes", F.coalesce(c("src").cast("string"), F.lit(""))), _entry("dst", "nodes", F.coalesce(c("dst").cast("string"), F.lit(""))), _entry("self-loop", bad=c("src") == c("dst"))]),
        _said(t["anchors"], "anchors", c("id"), [_entry("doc", "documents", F.coalesce(c("doc_id").cast("string"), F.lit(""))), _entry("target node", "nodes", c("target_node_id")), _entry("target entity", "entities", c("target_entity_id")), _entry("card", "cards", c("card_id"))]),
        _said(t["cards"], "cards", c("id"), [_entry("anchor", "anchors", F.coalesce(c("anchor_id").cast("string"), F.lit(""))), _entry("doc", "documents", F.coalesce(c("doc_id").cast("string"), F.lit("")))]),
        _said(t["entities"], "entities", c("id"), [_entry("canonical node", "nodes", c("canonical_node_id"))]),
    ]
    all_ = reduce(DataFrame.unionByName, said)
    limit = {"documents": c("page_count").cast("int")}
    keys = reduce(DataFrame.unionByName, [t[n].select(F.lit(n).alias("target"), c("id").cast("string").alias("key"), limit.get(n, F.lit(None).cast("int")).alias("limit")) for n in ("documents", "nodes", "entities", "anchors", "cards")])
    known = keys.where("key IS NOT NULL").groupBy("target", "key").agg(F.max("limit").alias("limit"), F.lit(True).alias("known"))
    named = all_.where("NOT bad").join(known, ["target", "key"], "left")
    late = c("known") & (c("limit") > 0) & (c("page") > c("limit"))
    wrong = named.where(F.when(c("page").isNotNull() | (c("rule") == "page"), F.coalesce(late, F.lit(False))).otherwise(c("known").isNull()))
    return wrong.select("table", "id", "rule").unionByName(all_.where("bad").select("table", "id", "rule"))


# What two runs must have in common, the least that a run must reach, and the stages of a full pipeline.
COMMON = ("corpus_hash", "model_config", "prompt_version", "scope", "pass")
QUALITY = ("c1_correct", "invalid_substitutions", "c3_correct", "false_merges")
LEAST_C1, ALL_C3 = 17, 3
FULL = ("segment", "edges", "embed", "resolve", "instantiate")


def incomparable(runs: DataFrame, cases: DataFrame, stages: DataFrame) -> DataFrame:
    """DQ-05: (pair, why) of every reason against comparing the two runs of a pair.

    runs: pair, side (0 before, 1 after), run_id, kind, the COMMON and QUALITY columns; cases: pair, side, case_id, result (null:
    none); stages: pair, side, stage, cost. A pair without two runs is a reason of its own.
    """
    fields = ["run_id", "kind", *COMMON, *QUALITY]
    side = lambda n: F.max_by(F.struct(*fields), F.when(F.col("side") == n, 1))
    both = runs.groupBy("pair").agg(side(0).alias("a"), side(1).alias("b"), F.count_if(F.col("side") == 0).alias("_a"), F.count_if(F.col("side") == 1).alias("_b"))
    by_case = cases.groupBy("pair", "case_id").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"), F.min(F.when(F.col("side") == 0, F.col("result"))).alias("x"), F.min(F.when(F.col("side") == 1, F.col("result"))).alias("y"))
    seen = by_case.groupBy("pair").agg(F.bool_or((F.col("a") != 1) | (F.col("b") != 1)).alias("_cases"), F.bool_or(((F.col("a") > 0) & F.col("x").isNull()) | ((F.col("b") > 0) & F.col("y").isNull())).alias("_evidence"), F.bool_or(F.col("x") != F.col("y")).alias("_results"))
    by_stage = stages.groupBy("pair", "stage").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"), F.sum(F.when(F.col("side") == 0, F.col("cost"))).alias("cost"))
    spent = by_stage.groupBy("pair").agg(F.bool_or((F.col("a") > 1) | (F.col("b") > 1)).alias("_twice"), F.bool_or((F.col("a") > 0) != (F.col("b") > 0)).alias("_cover"), F.count_if((F.col("a") > 0) & F.col("stage").isin(*FULL)).alias("_full"), F.sum("cost").alias("_cost"))
    all_ = both.join(seen, "pair", "left").join(spent, "pair", "left")
    poor = lambda r: ~F.coalesce((F.col(f"{r}.c1_correct") >= LEAST_C1) & (F.col(f"{r}.invalid_substitutions") == 0) & (F.col(f"{r}.c3_correct") == ALL_C3) & (F.col(f"{r}.false_merges") == 0), F.lit(False))
    differ = lambda f: ~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))
    rules = {
        "not two runs": (F.col("_a") != 1) | (F.col("_b") != 1),
        "synthetic": differ("kind") | ~F.col("a.kind").eqNullSafe(F.lit("live")),
        "the same run": F.col("a.run_id").eqNullSafe(F.col("b.run_id")),
        **{f"other {f}": differ(f) for f in COMMON},
        "cases differ or repeat": F.col("_cases"),
        "no evidence of a case": F.col("_evidence"),
        "quality too low": poor("a") | poor("b"),
        "stages repeat": F.col("_twice"),
        "results changed": F.col("_results"),
        "quality changed": reduce(lambda x, y: x | y, map(differ, QUALITY)),
        "other stages": F.coalesce("_cover", F.lit(True)),
        "stages missing": F.col("a.scope").eqNullSafe(F.lit("full-pipeline")) & (F.coalesce("_full", F.lit(0)) < len(FULL)),
        "no cost before": F.coalesce(F.col("_cost") <= 0, F.lit(True)),
    }
    whys = F.array(*[F.when(F.coalesce(bad, F.lit(False)), why) for why, bad in rules.items()])
    return all_.select("pair", F.explode(F.filter(whys, lambda w: w.isNotNull())).alias("why"))
