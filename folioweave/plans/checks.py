"""Queries of integrity over a whole graph and of what makes two runs incomparable."""

from pyspark.sql import functions as F

from ..operators import checks
from .registry import query

#: Customers as documents, orders as nodes, parts as entities, line items as edges, events as anchors, suppliers as cards; some rows break each rule.
GRAPH = """documents AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 50 = 0 THEN 'other' ELSE 'c' END AS corpus_id, c_nationkey AS page_count, c_custkey % 41 <> 0 AS stored FROM customer),
nodes AS (SELECT o_orderkey AS id, o_custkey + CASE WHEN o_orderkey % 97 = 0 THEN 1000000000 ELSE 0 END AS doc_id, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey * 2 END AS entity_id, o_orderkey % 30 AS page FROM orders),
entities AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 9 END AS canonical_node_id FROM part), edges AS (SELECT l_orderkey AS src, l_partkey * 8 AS dst FROM lineitem),
anchors AS (SELECT event_id AS id, user_id * 3 AS doc_id, CASE WHEN event_id % 3 = 0 THEN event_id * 2 END AS target_node_id, CASE WHEN event_id % 3 = 1 THEN user_id * 4 END AS target_entity_id, CASE WHEN event_id % 7 = 0 THEN user_id END AS card_id FROM events),
cards AS (SELECT s_suppkey AS id, s_suppkey * 99 AS anchor_id, s_nationkey * 70 AS doc_id FROM supplier)"""
_LOST = "SELECT '{t}' AS \"table\", {i}::VARCHAR AS id, '{r}' AS rule FROM {t} x WHERE {k} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {o} y WHERE y.id = x.{k})"
_NAMED = [("nodes", "id", "doc", "doc_id", "documents"), ("nodes", "id", "entity", "entity_id", "entities"), ("edges", "src || '>' || dst", "src", "src", "nodes"), ("edges", "src || '>' || dst", "dst", "dst", "nodes"), ("anchors", "id", "doc", "doc_id", "documents"), ("anchors", "id", "target node", "target_node_id", "nodes"), ("anchors", "id", "target entity", "target_entity_id", "entities"), ("anchors", "id", "card", "card_id", "cards"), ("cards", "id", "anchor", "anchor_id", "anchors"), ("cards", "id", "doc", "doc_id", "documents"), ("entities", "id", "canonical node", "canonical_node_id", "nodes")]
GRAPH_SQL = f"""WITH {GRAPH} SELECT 'documents' AS "table", id::VARCHAR AS id, 'corpus' AS rule FROM documents WHERE corpus_id <> 'c' UNION ALL SELECT 'documents', id::VARCHAR, 'file' FROM documents WHERE NOT stored
UNION ALL SELECT 'nodes', n.id::VARCHAR, 'page' FROM nodes n JOIN documents d ON d.id = doc_id WHERE page_count > 0 AND page > page_count UNION ALL SELECT 'edges', src || '>' || dst, 'self-loop' FROM edges WHERE src = dst
UNION ALL """ + " UNION ALL ".join(_LOST.format(t=t, i=i, r=r, k=k, o=o) for t, i, r, k, o in _NAMED)


@query("graph_checks", "DQ-01 DQ-02 SNK-08", GRAPH_SQL)
def graph_checks(t):
    c = F.col
    key, event = c("o_orderkey"), c("event_id")
    return checks.graph_problems(
        {
            "documents": t.customer.select(c("c_custkey").alias("id"), F.when(c("c_custkey") % 50 == 0, "other").otherwise("c").alias("corpus_id"), c("c_nationkey").alias("page_count"), (c("c_custkey") % 41 != 0).alias("stored")),
            "nodes": t.orders.select(key.alias("id"), (c("o_custkey") + F.when(key % 97 == 0, 10**9).otherwise(0)).alias("doc_id"), F.when(key % 5 == 0, c("o_custkey") * 2).alias("entity_id"), (key % 30).alias("page")),
            "entities": t.part.select(c("p_partkey").alias("id"), F.when(c("p_partkey") % 2 == 0, c("p_partkey") * 9).alias("canonical_node_id")),
            "edges": t.lineitem.select(c("l_orderkey").alias("src"), (c("l_partkey") * 8).alias("dst")),
            "anchors": t.events.select(event.alias("id"), (c("user_id") * 3).alias("doc_id"), F.when(event % 3 == 0, event * 2).alias("target_node_id"), F.when(event % 3 == 1, c("user_id") * 4).alias("target_entity_id"), F.when(event % 7 == 0, c("user_id")).alias("card_id")),
            "cards": t.supplier.select(c("s_suppkey").alias("id"), (c("s_suppkey") * 99).alias("anchor_id"), (c("s_nationkey") * 70).alias("doc_id")),
        },
        "c",
    )


#: Customers two by two as pairs of runs; their orders as cases and as stages.
RUNS = """runs AS (SELECT c_custkey // 2 AS pair, c_custkey % 2 AS side, c_custkey // 2 * 2 + CASE WHEN c_custkey % 13 = 1 THEN 0 ELSE c_custkey % 2 END AS run_id, CASE WHEN c_custkey % 11 = 0 THEN 'synthetic' ELSE 'live' END AS kind, c_nationkey < 23 AS usual,
  CASE WHEN c_custkey % 17 = 0 THEN 16 ELSE 18 END AS c1 FROM customer),
cases AS (SELECT o_custkey // 2 AS pair, o_custkey % 2 AS side, o_orderkey % 4 AS case_id, CASE WHEN o_orderkey % 9 > 0 THEN o_orderstatus END AS result FROM orders),
stages AS (SELECT o_custkey // 2 AS pair, o_custkey % 2 AS side, CASE o_orderkey % 6 WHEN 0 THEN 'segment' WHEN 1 THEN 'edges' WHEN 2 THEN 'embed' WHEN 3 THEN 'resolve' ELSE 'instantiate' END AS stage, CASE WHEN o_custkey % 10 < 2 THEN 0.0::DOUBLE ELSE o_totalprice END AS cost FROM orders)"""
RUNS_SQL = f"""WITH {RUNS}, n AS (SELECT pair, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM runs GROUP BY pair), two AS (SELECT a.pair, a.run_id = b.run_id AS same, a.kind AS ak, b.kind AS bk, a.usual <> b.usual AS other, a.c1 AS ac, b.c1 AS bc FROM runs a JOIN runs b ON a.pair = b.pair AND a.side = 0 AND b.side = 1),
k AS (SELECT pair, case_id, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b, min(result) FILTER (side = 0) AS x, min(result) FILTER (side = 1) AS y FROM cases GROUP BY ALL),
s AS (SELECT pair, stage, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b, sum(cost) FILTER (side = 0) AS cost FROM stages GROUP BY ALL), z AS (SELECT pair, sum(cost) AS cost, bool_or((a > 0) <> (b > 0)) AS cover, count(*) FILTER (a > 0) AS held FROM s GROUP BY pair)
SELECT pair, 'not two runs' AS why FROM n WHERE a <> 1 OR b <> 1 UNION ALL SELECT pair, 'synthetic' FROM two WHERE ak <> bk OR ak <> 'live' UNION ALL SELECT pair, 'the same run' FROM two WHERE same UNION ALL SELECT pair, 'other corpus_hash' FROM two WHERE other
UNION ALL SELECT pair, 'quality too low' FROM two WHERE ac < 17 OR bc < 17 UNION ALL SELECT pair, 'quality changed' FROM two WHERE ac <> bc
UNION ALL SELECT DISTINCT pair, 'cases differ or repeat' FROM k WHERE a <> 1 OR b <> 1 UNION ALL SELECT DISTINCT pair, 'no evidence of a case' FROM k WHERE a > 0 AND x IS NULL OR b > 0 AND y IS NULL UNION ALL SELECT DISTINCT pair, 'results changed' FROM k WHERE x <> y
UNION ALL SELECT DISTINCT pair, 'stages repeat' FROM s WHERE a > 1 OR b > 1 UNION ALL SELECT n.pair, 'other stages' FROM n LEFT JOIN z USING (pair) WHERE coalesce(cover, true) UNION ALL SELECT n.pair, 'stages missing' FROM n LEFT JOIN z USING (pair) WHERE coalesce(held, 0) < 5 UNION ALL SELECT n.pair, 'no cost before' FROM n LEFT JOIN z USING (pair) WHERE coalesce(cost, 0) <= 0"""


@query("run_checks", "DQ-05 AGG-20", RUNS_SQL)
def run_checks(t):
    c = F.col
    k, o = c("c_custkey"), c("o_orderkey")
    pair = lambda x: F.floor(x / 2)
    same = {"model_config": "m", "prompt_version": "p", "scope": "full-pipeline", "pass": "cold"}
    marks = {"invalid_substitutions": 0, "c3_correct": 3, "false_merges": 0}
    runs = t.customer.select(
        pair(k).alias("pair"), (k % 2).alias("side"), (pair(k) * 2 + F.when(k % 13 == 1, 0).otherwise(k % 2)).alias("run_id"), F.when(k % 11 == 0, "synthetic").otherwise("live").alias("kind"), (c("c_nationkey") < 23).alias("corpus_hash"),
        F.when(k % 17 == 0, 16).otherwise(18).alias("c1_correct"), *[F.lit(v).alias(n) for n, v in {**same, **marks}.items()],
    )
    mine = t.orders.select(pair(c("o_custkey")).alias("pair"), (c("o_custkey") % 2).alias("side"), "o_orderkey", "o_orderstatus", "o_custkey", "o_totalprice")
    cases = mine.select("pair", "side", (o % 4).alias("case_id"), F.when(o % 9 > 0, c("o_orderstatus")).alias("result"))
    stage = F.when(o % 6 == 0, "segment").when(o % 6 == 1, "edges").when(o % 6 == 2, "embed").when(o % 6 == 3, "resolve").otherwise("instantiate")
    stages = mine.select("pair", "side", stage.alias("stage"), F.when(c("o_custkey") % 10 < 2, 0.0).otherwise(c("o_totalprice")).alias("cost"))
    return checks.incomparable(runs, cases, stages)
