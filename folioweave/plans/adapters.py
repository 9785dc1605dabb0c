"""Views of the test tables in the shape of the graph model, for Spark and, under the same names, for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import Tables

#: events as a ledger of calls.
LEDGER = "ledger AS (SELECT event_id AS id, event_type AS stage, value AS cost, CAST(json_extract_string(props, '$.k') AS INT) AS k, ts, user_id FROM events)"
#: parts as nodes; parts of one order are connected, the larger key depends on the smaller.
NODES = "nodes AS (SELECT p_partkey AS id, p_brand AS corpus, p_type AS kind, p_name AS title, p_size AS page FROM part)"
EDGES = """pairs AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
edges AS (SELECT a.l_partkey AS src, b.l_partkey AS dst, least(1.0::DOUBLE, (5 + count(*)) / 10.0::DOUBLE) AS confidence FROM pairs a JOIN pairs b ON a.l_orderkey = b.l_orderkey AND a.l_partkey > b.l_partkey GROUP BY 1, 2)"""
TURNS = "turns AS (SELECT conv_id AS doc, turn AS pos, role AS kind, text AS statement FROM conversations)"
LINES = "lines AS (SELECT doc_id, (i - 1)::INT AS pos, ((i - 1) // 10 + 1)::INT AS page, ls[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"
#: Integer rectangles: nodes from parts, anchors from line items. Fifty parts are a document of five pages, so pages grow in number with the
#: tables, and every anchor stands on a page that has boxes.
RECTS = """boxes AS (SELECT p_partkey AS id, p_partkey // 50 AS doc, p_partkey % 5 + 1 AS page, (p_partkey * 7) % 300 AS x0, (p_partkey * 13) % 500 AS y0,
  (p_partkey * 7) % 300 + 60 + (p_partkey * 3) % 200 AS x1, (p_partkey * 13) % 500 + 40 + (p_partkey * 5) % 150 AS y1, p_name AS name FROM part),
marks AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey // 50 AS doc, l_linenumber % 5 + 1 AS page, (l_partkey * 11) % 400 AS x0, (l_orderkey * 17) % 600 AS y0,
  (l_partkey * 11) % 400 + 20 AS x1, (l_orderkey * 17) % 600 + 10 AS y1, l_returnflag AS surface FROM lineitem)"""
#: The same boxes on five hundred pages, which fill up as the table grows.
CROWDED = RECTS.replace("p_partkey // 50 AS doc, p_partkey % 5 + 1 AS page", "p_partkey % 100 AS doc, p_size % 5 + 1 AS page")
#: Orders as documents of numbered statements that cite each other.
STATEMENTS = """raw AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_partkey, l_quantity, l_returnflag FROM lineitem),
statements AS (SELECT doc, n::INT AS n, (n // 3 + 1)::INT AS page, CASE n % 4 WHEN 0 THEN 'definition' WHEN 1 THEN 'lemma' WHEN 2 THEN 'theorem' ELSE 'proposition' END AS kind,
  CASE n % 4 WHEN 0 THEN 'Definition ' WHEN 1 THEN 'Lemma ' WHEN 2 THEN 'Theorem ' ELSE 'Proposition ' END || ((l_partkey % 3) + 1)::VARCHAR || '.' || n::VARCHAR AS label,
  p_name AS title,
  CASE WHEN n = 1 THEN 'Let x be given.' WHEN l_quantity < 13 THEN 'This is as above.' WHEN l_quantity < 25 THEN 'By the previous lemma we are done.'
    WHEN l_quantity < 38 THEN 'By Lemma 1.1 and Theorem 2.2 it holds.' ELSE 'It restates Lemma 2.1 for every ' || p_brand || '.' END AS body
  FROM raw JOIN part ON l_partkey = p_partkey)"""


def ledger(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.col("value").alias("cost"), F.get_json_object("props", "$.k").cast("int").alias("k"), "ts", "user_id")


def nodes(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("corpus"), F.col("p_type").alias("kind"), F.col("p_name").alias("title"), F.col("p_size").alias("page"))


#: Line items whose pairs one task counts.
LINES_A_TASK = 250_000


def edges(t: Tables, by: str = "src") -> DataFrame:
    """Edges dealt by one end, so what groups or ranks by it finds them where they are."""
    # Tasks grow in number with the lines, so none holds more orders, or pairs, as the table grows. An order's parts are one list, from which pairs
    # stream; hardly a pair comes twice, so they move before they are counted.
    lines = t.lineitem.select("l_orderkey", "l_partkey").where("l_orderkey IS NOT NULL")
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // LINES_A_TASK))
    parts = lines.repartition(tasks, "l_orderkey").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("parts"))
    pairs = parts.select("parts", F.explode("parts").alias("src")).select("src", F.explode(F.filter("parts", lambda x: x < F.col("src"))).alias("dst")).repartition(tasks, by)
    confidence = F.least(F.lit(1.0), (F.count("*") + 5) / F.lit(10.0))
    return pairs.groupBy("src", "dst").agg(confidence.alias("confidence"))


def turns(t: Tables) -> DataFrame:
    return t.conversations.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"), F.col("role").alias("kind"), F.col("text").alias("statement"))


def lines(t: Tables) -> DataFrame:
    cut = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return cut.select("doc_id", "pos", (F.floor(F.col("pos") / 10) + 1).cast("int").alias("page"), "line")


def boxes(t: Tables, doc: Column | None = None, page: Column | None = None) -> DataFrame:
    k = F.col("p_partkey")
    x, y = (k * 7) % 300, (k * 13) % 500
    doc, page = F.floor(k / 50) if doc is None else doc, k % 5 + 1 if page is None else page
    return t.part.select(k.alias("id"), doc.alias("doc"), page.alias("page"), x.alias("x0"), y.alias("y0"), (x + 60 + (k * 3) % 200).alias("x1"), (y + 40 + (k * 5) % 150).alias("y1"), F.col("p_name").alias("name"))


def crowded(t: Tables) -> DataFrame:
    """The boxes of CROWDED."""
    return boxes(t, F.col("p_partkey") % 100, F.col("p_size") % 5 + 1)


def marks(t: Tables) -> DataFrame:
    x, y = (F.col("l_partkey") * 11) % 400, (F.col("l_orderkey") * 17) % 600
    return t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.floor(F.col("l_partkey") / 50).alias("doc"), (F.col("l_linenumber") % 5 + 1).alias("page"), x.alias("x0"), y.alias("y0"), (x + 20).alias("x1"), (y + 10).alias("y1"), F.col("l_returnflag").alias("surface"))


def statements(t: Tables, *more: str) -> DataFrame:
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    raw = t.lineitem.select(F.col("l_orderkey").alias("doc"), n.alias("n"), "l_partkey", "l_quantity", *more).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    # Dealt by document while a line is a few numbers: its texts are made where the document's rules, windows and groups are. Tasks grow in number with the lines.
    raw = raw.select("doc", "n", "l_partkey", "l_quantity", "p_name", "p_brand", *more).repartition(max(t.spark.sparkContext.defaultParallelism, -(-t.lineitem.count() // LINES_A_TASK)), "doc")
    word = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("n") % 4 + 1).cast("int"))
    body = (
        F.when(F.col("n") == 1, "Let x be given.")
        .when(F.col("l_quantity") < 13, "This is as above.")
        .when(F.col("l_quantity") < 25, "By the previous lemma we are done.")
        .when(F.col("l_quantity") < 38, "By Lemma 1.1 and Theorem 2.2 it holds.")
        .otherwise(F.concat(F.lit("It restates Lemma 2.1 for every "), "p_brand", F.lit(".")))
    )
    label = F.concat(word("Definition ", "Lemma ", "Theorem ", "Proposition "), (F.col("l_partkey") % 3 + 1).cast("string"), F.lit("."), F.col("n").cast("string"))
    return raw.select("doc", "n", (F.floor(F.col("n") / 3) + 1).cast("int").alias("page"), word("definition", "lemma", "theorem", "proposition").alias("kind"), label.alias("label"), F.col("p_name").alias("title"), body.alias("body"), *more)
