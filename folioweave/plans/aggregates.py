"""Queries of aggregations, windows and sets."""

from pyspark.sql import functions as F

from ..operators import aggregates as A
from . import adapters as V
from .registry import query

SMALL = "k % 2 = 0"


@query("cost_by_stage", "AGG-01 FLT-04 SRT-02", f"WITH {V.LEDGER} SELECT stage, count(*) AS calls, sum(k)::BIGINT AS tokens, round(sum(cost), 4) AS cost FROM ledger WHERE coalesce(k, 0) <> 7 GROUP BY stage")
def cost_by_stage(t):
    return A.cost_by_stage(V.ledger(t), F.coalesce("k", F.lit(0)) != 7).orderBy(F.desc("cost"), "stage")


@query("cost_rollup", "AGG-02", f"WITH {V.LEDGER} SELECT coalesce(stage, 'all') AS stage, count(*) AS calls, round(coalesce(sum(cost), 0), 4) AS cost, grouping(stage)::INT AS total, count(*) > 0 AS measured FROM ledger GROUP BY ROLLUP (stage)")
def cost_rollup(t):
    return A.cost_rollup(V.ledger(t))


@query("collapse_edges", "AGG-03", "SELECT l_partkey AS src, l_suppkey AS dst, max(l_discount) AS confidence FROM lineitem GROUP BY 1, 2")
def collapse_edges(t):
    return A.collapse_edges(t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_discount").alias("confidence")))


@query("committed_spend", "AGG-04", "SELECT coalesce(sum(coalesce(CASE WHEN o_orderstatus = 'F' THEN floor(o_totalprice)::BIGINT END, ceil(o_totalprice)::BIGINT)), 0)::BIGINT AS committed FROM orders")
def committed_spend(t):
    return A.committed(t.orders.select(F.when(F.col("o_orderstatus") == "F", F.floor("o_totalprice")).alias("actual"), F.ceil("o_totalprice").alias("maximum")))


@query("opening_balance", "AGG-05 NUM-03", f"WITH {V.LEDGER} SELECT ceil(coalesce(sum(cost::DECIMAL(18, 6)), 0) * 1000000)::BIGINT AS opening FROM ledger")
def opening_balance(t):
    return A.opening_balance(V.ledger(t))


@query("ordered_rows", "AGG-06 JSN-01", "SELECT o_custkey, to_json(list(o_orderkey ORDER BY o_orderdate, o_orderkey))::VARCHAR AS rows FROM orders GROUP BY o_custkey")
def ordered_rows(t):
    return A.ordered_rows(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderkey").withColumn("rows", F.to_json("rows"))


@query("distinct_pairs", "AGG-07", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_pairs(t):
    return t.lineitem.select("l_partkey", "l_suppkey").distinct()


@query("counts", "AGG-08", "SELECT count(*) AS n, count(CASE WHEN o_totalprice > 250000 THEN 1 END) AS large FROM orders")
def counts(t):
    return t.orders.agg(F.count("*").alias("n"), F.count(F.when(F.col("o_totalprice") > 250000, 1)).alias("large"))


@query("best_same", "AGG-09", "SELECT l_partkey, max(CASE WHEN l_returnflag = 'A' THEN l_discount END) AS best FROM lineitem GROUP BY 1")
def best_same(t):
    return A.best_where(t.lineitem, "l_partkey", F.col("l_returnflag") == "A", "l_discount")


@query("union_box", "AGG-10 GEO-01", f"WITH {V.RECTS} SELECT doc, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM boxes GROUP BY doc, page")
def union_box(t):
    return A.union_box(V.boxes(t), ["doc", "page"])


@query("page_text", "AGG-11 EXT-01", f"WITH {V.LINES} SELECT doc_id, page, string_agg(trim(line, ' '), ' ' ORDER BY pos) AS text FROM lines GROUP BY doc_id, page")
def page_text(t):
    return A.joined_text(V.lines(t).withColumn("line", F.trim("line")), ["doc_id", "page"], ["pos"], "line", " ")


@query(
    "parse_quality",
    "AGG-12 FLT-07",
    f"""WITH {V.LINES}, q AS (SELECT doc_id, count(DISTINCT CASE WHEN length(trim(line, ' ')) > 0 THEN page END) AS filled, sum(length(line)) AS characters, max(page) AS pages FROM lines GROUP BY doc_id),
s AS (SELECT doc_id, round(greatest(0.0, least(1.0, 0.55 * (filled / pages) + 0.25 * least(1.0, characters / (pages * 400.0)) + 0.20 * (1.0 - (pages - filled) / pages))), 6)::DOUBLE AS quality FROM q)
SELECT doc_id, quality, CASE WHEN quality >= 0.8 THEN 'ready' ELSE 'unsupported' END AS status FROM s""",
)
def parse_quality(t):
    from ..operators.relational import quality_gate

    return quality_gate(A.parse_quality(V.lines(t), "doc_id", F.max("page")))


@query(
    "library_metrics",
    "AGG-13",
    f"""WITH {V.NODES}, {V.EDGES}, n AS (SELECT corpus, count(*) AS nodes FROM nodes GROUP BY corpus), e AS (SELECT corpus, count(*) AS edges FROM edges JOIN nodes ON src = id GROUP BY corpus)
SELECT corpus, nodes, coalesce(edges, 0) AS edges, round(coalesce(edges, 0) / nodes, 6) AS per_node FROM n LEFT JOIN e USING (corpus)""",
)
def library_metrics(t):
    nodes = V.nodes(t)
    n = nodes.groupBy("corpus").agg(F.count("*").alias("nodes"))
    e = V.edges(t).join(nodes, F.col("src") == F.col("id")).groupBy("corpus").agg(F.count("*").alias("edges"))
    edges = F.coalesce("edges", F.lit(0))
    return n.join(e, "corpus", "left").select("corpus", "nodes", edges.alias("edges"), F.round(edges / F.col("nodes"), 6).alias("per_node"))


@query(
    "unique_identity",
    "AGG-15",
    f"WITH {V.NODES}, g AS (SELECT title, count(DISTINCT kind) AS n, min((page, id)) AS f FROM nodes WHERE title IS NOT NULL GROUP BY title, corpus) SELECT title, n, (f)[2]::BIGINT AS id FROM g WHERE n = 1".replace("(f)[2]", "f[2]"),
)
def unique_identity(t):
    named = V.nodes(t).where("title IS NOT NULL").withColumn("name", F.struct("title", "corpus"))
    return A.unique_identity(named, "name", F.col("kind"), ["page", "id"], "id").select(F.col("name.title").alias("title"), F.lit(1).cast("long").alias("n"), "id")


EVAL = "f AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_discount < 0.06), w AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_tax < 0.05)"


def _sides(t):
    pick = lambda c: t.lineitem.where(c).select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    return pick("l_discount < 0.06"), pick("l_tax < 0.05")


@query(
    "edge_scores",
    "AGG-16",
    f"""WITH {EVAL}, n AS (SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM w) AS wanted, (SELECT count(*) FROM f JOIN w USING (src, dst)) AS hits)
SELECT *, round(hits / found, 6) AS precision, round(hits / wanted, 6) AS recall, round(2 * (hits / found) * (hits / wanted) / (hits / found + hits / wanted), 6) AS f1 FROM n""",
)
def edge_scores(t):
    return A.edge_scores(*_sides(t), ["src", "dst"])


@query("set_report", "SET-02", f"WITH {EVAL} (SELECT *, 'missing' AS side FROM (SELECT * FROM w EXCEPT ALL SELECT * FROM f)) UNION ALL (SELECT *, 'extra' AS side FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM w))")
def set_report(t):
    return A.set_report(*_sides(t))


@query(
    "bag_recall",
    "AGG-17",
    """WITH f AS (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey, l_returnflag) AS r FROM lineitem WHERE l_discount < 0.06),
w AS (SELECT l_suppkey, l_returnflag, row_number() OVER (PARTITION BY l_suppkey, l_returnflag) AS r FROM lineitem WHERE l_tax < 0.05)
SELECT (SELECT count(*) FROM w) AS wanted, count(*) AS hits, round(count(*) / (SELECT count(*) FROM w), 6) AS recall FROM w JOIN f USING (l_suppkey, l_returnflag, r)""",
)
def bag_recall(t):
    return A.bag_recall(t.lineitem.where("l_discount < 0.06"), t.lineitem.where("l_tax < 0.05"), ["l_suppkey", "l_returnflag"])


@query("counts_by_kind", "AGG-18", "WITH f AS (SELECT p_type, count(*) AS found FROM part WHERE p_size < 20 GROUP BY 1), w AS (SELECT p_type, count(*) AS wanted FROM part WHERE p_size > 10 GROUP BY 1) SELECT p_type, coalesce(found, 0) AS found, coalesce(wanted, 0) AS wanted FROM f FULL JOIN w USING (p_type)")
def counts_by_kind(t):
    return A.counts_by_kind(t.part.where("p_size < 20"), t.part.where("p_size > 10"), "p_type")


@query(
    "latency",
    "AGG-19",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, max(CASE WHEN i = floor(n * 0.95) THEN value END) AS p95 FROM r GROUP BY event_type""",
)
def latency(t):
    return A.latency(t.events, "event_type", "value")


@query(
    "cost_reduction",
    "AGG-20 DQ-05",
    f"""WITH {V.LEDGER}, a AS (SELECT stage, sum(cost) AS a FROM ledger WHERE k % 2 = 0 GROUP BY 1), b AS (SELECT stage, sum(cost) AS b FROM ledger WHERE k % 2 = 1 AND stage <> 'view' GROUP BY 1)
SELECT stage, round(a, 4) AS before, round(b, 4) AS after, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND a > 0 THEN round((a - b) / a * 100, 4) END AS saved, (a IS NOT NULL AND b IS NOT NULL AND coalesce(a > 0, false)) AS comparable FROM a FULL JOIN b USING (stage)""",
)
def cost_reduction(t):
    ledger = V.ledger(t)
    return A.cost_reduction(ledger.where("k % 2 = 0"), ledger.where("k % 2 = 1 AND stage <> 'view'"))


@query("reading_order", "WIN-01", f"WITH {V.RECTS} SELECT id, doc, row_number() OVER (PARTITION BY doc ORDER BY page, y0, x0, id)::INT AS n FROM boxes")
def reading_order(t):
    return A.numbered(V.boxes(t), ["doc"], ["page", "y0", "x0", "id"]).select("id", "doc", "n")


SPANS = f"{V.RECTS}, spans AS (SELECT id, doc, page, x0 / 4.0 AS x0, y0 AS y0, y0 + 9.0 AS y1, 8.0 + id % 4 AS size, id % 3 AS block FROM boxes)"


@query(
    "paragraphs",
    "WIN-02",
    f"""WITH {SPANS}, l AS (SELECT *, lag(page) OVER w AS pp, y0 - lag(y1) OVER w AS gap, greatest(size, lag(size) OVER w, 1.0) * 0.85 AS lim, abs(x0 - lag(x0) OVER w) AS dx, lag(block) OVER w AS pb FROM spans WINDOW w AS (PARTITION BY doc ORDER BY page, y0, x0, id)),
s AS (SELECT *, CASE WHEN pp IS NULL THEN 0 WHEN pp <> page THEN 1 WHEN gap > lim OR (dx > 12 AND gap > lim * 0.4) OR (pb <> block AND gap > 2) THEN 1 ELSE 0 END AS st FROM l)
SELECT id, doc, (sum(st) OVER (PARTITION BY doc ORDER BY page, y0, x0, id ROWS UNBOUNDED PRECEDING))::INT AS para FROM s""",
)
def paragraphs(t):
    spans = V.boxes(t).select("id", "doc", "page", (F.col("x0") / 4.0).alias("x0"), "y0", (F.col("y0") + 9.0).alias("y1"), (F.lit(8.0) + F.col("id") % 4).alias("size"), (F.col("id") % 3).alias("block"))
    return A.paragraphs(spans).select("id", "doc", "para")


@query(
    "blocks",
    "WIN-03 EXT-03",
    f"""WITH {V.TURNS}, m AS (SELECT *, kind = 'user' AS s, (kind <> 'user' AND length(statement) < 300) AS b FROM turns),
k AS (SELECT *, sum(s::INT) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS block FROM m),
c AS (SELECT *, max(b::INT) OVER (PARTITION BY doc, block ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cut FROM k WHERE block > 0) SELECT doc, pos, block::BIGINT AS block FROM c WHERE cut = 0""",
)
def blocks(t):
    return A.blocks(V.turns(t), "doc", ["pos"], F.col("kind") == "user", F.length("statement") < 300).select("doc", "pos", "block")


@query(
    "previous_result",
    "WIN-04",
    f"WITH {V.STATEMENTS}, p AS (SELECT doc, n, page, kind, lag(label) OVER w AS pl, lag(kind) OVER w AS pk, lag(page) OVER w AS pp FROM statements WINDOW w AS (PARTITION BY doc ORDER BY n)) SELECT doc, n, CASE WHEN pk <> 'definition' AND page - pp <= 1 THEN pl END AS previous FROM p",
)
def previous_result(t):
    before = A.previous(V.statements(t), ["doc"], ["n"], F.struct("label", "kind", "page"))
    ok = (F.col("previous.kind") != "definition") & (F.col("page") - F.col("previous.page") <= 1)
    return before.select("doc", "n", F.when(ok, F.col("previous.label")).alias("previous"))


@query("top_children", "WIN-05 JN-06", f"WITH {V.EDGES} SELECT src, dst, confidence, row_number() OVER (PARTITION BY src ORDER BY confidence DESC, dst)::INT AS rank FROM edges QUALIFY rank <= 3")
def top_children(t):
    return A.top_children(V.edges(t), 3)


@query("batches", "WIN-06", "SELECT o_orderkey, o_custkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 6)::INT AS batch FROM orders")
def batches(t):
    return A.batches(t.orders.select("o_orderkey", "o_custkey"), ["o_custkey"], ["o_orderkey"], 6)


@query(
    "greedy_batches",
    "WIN-06",
    """WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, floor(o_totalprice)::BIGINT AS bytes, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders),
f AS (SELECT o_custkey, o_orderkey, r, 0 AS batch, 1 AS n, bytes AS total FROM o WHERE r = 1 UNION ALL
SELECT o.o_custkey, o.o_orderkey, o.r, CASE WHEN f.n = 4 OR f.total + o.bytes > 800000 THEN f.batch + 1 ELSE f.batch END, CASE WHEN f.n = 4 OR f.total + o.bytes > 800000 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n = 4 OR f.total + o.bytes > 800000 THEN o.bytes ELSE f.total + o.bytes END
FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.r = f.r + 1) SELECT o_custkey, o_orderkey, batch FROM f""",
)
def greedy_batches(t):
    rows = t.orders.select("o_custkey", "o_orderkey", F.floor("o_totalprice").alias("bytes"))
    return A.greedy_batches(rows, "o_custkey", "o_orderkey", "bytes", 4, 800_000).select("o_custkey", "o_orderkey", "batch")


@query("top_orders", "SRT-01 LIM-01", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_orders(t):
    return A.top(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), "o_orderkey"], 20)


@query(
    "within_budget",
    "LIM-02",
    f"""WITH {V.TURNS}, r AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY pos) AS r, CASE WHEN length(statement) > 1000 THEN '[too long]' ELSE statement END AS shown FROM turns),
u AS (SELECT doc, r, shown, sum(length(shown)) OVER (PARTITION BY doc ORDER BY r ROWS UNBOUNDED PRECEDING) AS used FROM r WHERE r <= 3) SELECT doc, r::INT AS rank, shown, used::BIGINT AS used FROM u WHERE used <= 1000""",
)
def within_budget(t):
    return A.within_budget(V.turns(t), "doc", ["pos"], "statement", 1000)


@query("union_all", "SET-01", "SELECT c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT s_suppkey, s_nationkey FROM supplier")
def union_all(t):
    return A.union_all(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")), t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))


@query("first_of", "SET-03", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def first_of(t):
    return A.first_of(t.orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")
