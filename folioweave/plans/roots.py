"""Queries of trace roots and of what remains."""

from pyspark.sql import functions as F

from ..operators import extract, relational, resolve, roots, tables
from ..operators.versions import Stale, Versions
from ..sources import readers, sinks
from . import adapters as V
from .feeds import _folder
from .registry import query

SEEN = f"{V.STATEMENTS}, x AS (SELECT *, doc * 100 + n AS id FROM statements), c AS (SELECT doc, label, page, id FROM x WHERE label IN ('Lemma 1.1', 'Theorem 2.2'))"


def _nodes(t):
    return V.statements(t).withColumn("id", F.col("doc") * 100 + F.col("n")).withColumn("entity", F.lit(None).cast("string")).withColumn("statement", F.col("body"))


def _requests(t, text, page=1):
    return t.lineitem.select(F.col("l_orderkey").alias("doc")).distinct().select(F.col("doc").alias("request"), "doc", F.lit(page).cast("int").alias("page"), F.lit(text).alias("selection"))


@query("named_roots", "GRF-01 STR-03 AGG-15", f"WITH {SEEN}, g AS (SELECT doc AS request, label, count(*) FILTER (page = 1) AS n1, min(id) FILTER (page = 1) AS f1, count(*) AS n2, min(id) AS f2 FROM c GROUP BY ALL) SELECT DISTINCT request, CASE WHEN n1 = 1 THEN f1 WHEN n1 = 0 AND n2 = 1 THEN f2 END AS id FROM g WHERE n1 = 1 OR (n1 = 0 AND n2 = 1)")
def named_roots(t):
    return roots.named_roots(_nodes(t).drop("title").withColumn("title", F.lit(None).cast("string")), _requests(t, "by LEMMA  1.1 and theorem 2.2, not Theorem 2.25"))


@query("passage_roots", "GRF-02", f"WITH {SEEN} SELECT doc AS request, min(id) AS id FROM x WHERE page = 1 AND body = 'By Lemma 1.1 and Theorem 2.2 it holds.' GROUP BY doc HAVING count(*) = 1")
def passage_roots(t):
    return roots.passage_roots(_nodes(t), _requests(t, "Lemma 1.1 and  Theorem 2.2 it holds"))


@query("anchor_roots", "GRF-02", f"WITH {SEEN} SELECT doc AS request, min(id) AS id FROM x WHERE page = 1 AND body LIKE 'It restates%' GROUP BY doc HAVING count(DISTINCT title) = 1")
def anchor_roots(t):
    a = _nodes(t).where("body LIKE 'It restates%'").select("doc", "page", F.lit("Lemma 2.1").alias("surface"), F.col("id").alias("target"), F.col("title").alias("identity"))
    return roots.anchor_roots(a, _requests(t, "as lemma 2.1 says"))


@query("refined_anchors", "ANC-05", f"WITH {V.RECTS}, g AS (SELECT doc, page, name AS surface, x0 + 5 AS x0, y0 + 5 AS y0, x1 - 5 AS x1, y1 - 5 AS y1 FROM boxes), m AS (SELECT b.id, max(g.x0) AS gx, count(*) AS n FROM boxes b JOIN g ON g.doc = b.doc AND g.page = b.page AND g.surface = b.name AND g.x0 >= b.x0 - 2 AND g.y0 >= b.y0 - 2 AND g.x1 <= b.x1 + 2 AND g.y1 <= b.y1 + 2 GROUP BY b.id) SELECT id, CASE WHEN n = 1 THEN gx ELSE x0 END AS x0 FROM boxes LEFT JOIN m USING (id)")
def refined_anchors(t):
    b = V.boxes(t).withColumnRenamed("name", "surface")
    g = b.select("doc", "page", "surface", (F.col("x0") + 5).alias("x0"), (F.col("y0") + 5).alias("y0"), (F.col("x1") - 5).alias("x1"), (F.col("y1") - 5).alias("y1"))
    return extract.refined(b, g).select("id", "x0")


@query("golden_nodes", "SRC-03 SNK-08 ARR-01", "SELECT o_orderkey::VARCHAR AS id, o_orderpriority AS label, o_custkey::VARCHAR AS doc_id FROM orders")
def golden_nodes(t):
    """Customers as documents with their orders as nodes, written as one JSON object a line and read as golden files."""
    node = F.struct(F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("doc_id"), F.lit("theorem").alias("kind"), F.col("o_orderpriority").alias("label"))
    docs = t.orders.groupBy("o_custkey").agg(F.collect_list(node).alias("nodes")).select(F.struct(F.col("o_custkey").cast("string").alias("id")).alias("document"), "nodes", "o_custkey")
    path = _folder(t, "golden")
    docs.drop("o_custkey").write.json(path)
    raw = t.spark.read.schema(readers.GOLDEN).json(path)
    return raw.select(F.explode("nodes").alias("x")).select("x.id", "x.label", "x.doc_id")


@query("manifest_edges", "SRC-11", "SELECT o_orderkey::VARCHAR AS src, o_custkey::VARCHAR AS dst, 'depends_on' AS kind, o_orderstatus AS evidence FROM orders")
def manifest_edges(t):
    """A manifest a customer, one object a line."""
    row = F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), F.lit("depends_on"), "o_orderstatus")
    path = _folder(t, "manifest")
    edges = t.orders.groupBy("o_custkey").agg(F.collect_list(row).alias("edges")).drop("o_custkey")
    sinks.write_lines(edges.withColumn("version", F.lit(1)), path)
    return readers.manifest(t.spark, path, lines=True)


@query("limited_hits", "FLT-06 LIM-01 DAT-01", "SELECT c_custkey, c_acctbal, true AS fresh FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50")
def limited_hits(t):
    hits = t.customer.select("c_custkey", "c_acctbal", (F.current_timestamp() > F.lit("2020-01-01").cast("timestamp")).alias("fresh"))
    return hits.orderBy(F.desc("c_acctbal"), "c_custkey").limit(relational.checked_limit(50))


@query("fingerprint", "RES-07", "SELECT true AS same, false AS other")
def fingerprint(t):
    """The same rows in another order and other partitions have the same fingerprint, others another one."""
    mark = resolve.fingerprint(t.part, "p_partkey")
    again = resolve.fingerprint(t.part.repartition(7, "p_name"), "p_partkey")
    other = resolve.fingerprint(t.part.withColumn("p_size", F.col("p_size") + 1), "p_partkey")
    return t.spark.createDataFrame([(mark == again, mark == other)], "same boolean, other boolean")


@query("committed_plan", "RES-07", "SELECT p_name AS entity, min(p_partkey) AS first, count(*)::BIGINT AS n FROM part GROUP BY p_name")
def committed_plan(t):
    """Of two plans on one snapshot the first is committed and the second refused, as is one on a changed snapshot; what the last version names is read."""
    versions = Versions(t.spark, tables.folder(t.spark, "versions"))
    snapshot, changed = t.part.select("p_partkey", "p_name"), t.part.where("p_partkey > 0").select("p_partkey", "p_name")
    plans = [resolve.planned(versions, df, "p_partkey") for df in (snapshot, snapshot.repartition(5), changed)]
    for plan, value in zip(plans, (F.min("p_partkey"), F.max("p_partkey"), F.max("p_partkey")), strict=True):
        made = tables.stage(snapshot.groupBy(F.col("p_name").alias("entity")).agg(value.alias("first"), F.count("*").alias("n")), "entities")
        try:
            resolve.committed(versions, plan, snapshot, "p_partkey", {"entities": made.path})
        except Stale:
            made.drop()
    return t.spark.read.parquet(versions.latest()[1]["tables"]["entities"])
