"""Queries of projections, filters and joins."""

from pyspark.sql import functions as F

from ..operators import relational as R
from . import adapters as V
from .registry import query


@query("node_summary", "PRJ-01 PRJ-02 PRJ-03 PRJ-05", f"WITH {V.STATEMENTS} SELECT doc * 100 + n AS id, kind, coalesce(CASE WHEN n % 3 = 0 THEN title END, label, kind) AS headline, doc AS doc_id, page FROM statements")
def node_summary(t):
    rows = V.statements(t).withColumn("id", F.col("doc") * 100 + F.col("n")).withColumn("title", F.when(F.col("n") % 3 == 0, F.col("title")))
    return R.summary(rows).select("id", "kind", "headline", "source.doc_id", "source.page")


@query("scoped_edges", "FLT-01 JN-02", f"WITH {V.NODES}, {V.EDGES} SELECT src, dst, confidence, a.corpus FROM edges JOIN nodes a ON src = a.id JOIN nodes b ON dst = b.id WHERE a.corpus = b.corpus")
def scoped_edges(t):
    return R.scoped_edges(V.edges(t), V.nodes(t)).select("src", "dst", "confidence", "corpus")


@query("optional_filter", "FLT-02 FLT-03", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_custkey NOT IN (1, 2, 3)")
def optional_filter(t):
    rows = R.optional(R.optional(t.orders, "o_orderstatus", "F"), "o_custkey", None)
    return rows.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_custkey").isin(1, 2, 3)).select("o_orderkey", "o_orderpriority")


@query("disjunctive_scope", "FLT-05", "SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') OR o_orderstatus = 'P'")
def disjunctive_scope(t):
    docs = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc"))
    return R.in_scope(t.orders, F.col("o_orderpriority") == "1-URGENT", docs, "o_custkey", F.col("o_orderstatus") == "P").select("o_orderkey")


@query("weak_spots", "FLT-08", "WITH s AS (SELECT user_id AS id, count(*) FILTER (event_type = 'error') AS hover_count FROM events GROUP BY 1) SELECT c_custkey AS id, hover_count FROM customer JOIN s ON c_custkey = id WHERE coalesce(hover_count, 0) >= 3")
def weak_spots(t):
    state = t.events.groupBy(F.col("user_id").alias("id")).agg(F.count_if(F.col("event_type") == "error").alias("hover_count"))
    return R.weak_spots(t.customer.select(F.col("c_custkey").alias("id")), state)


@query("map_filter", "FLT-09", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%ring%' OR lower(p_type) LIKE '%ring%'")
def map_filter(t):
    return R.contains_text(t.part, ["p_name", "p_type"], "RING").select("p_partkey")


@query("contains_all", "FLT-10", "SELECT doc_id FROM documents WHERE lower(text) LIKE '%the%' AND lower(text) LIKE '%license%' ORDER BY doc_id LIMIT 20")
def contains_all(t):
    return R.contains_all(t.documents.select("doc_id", "text"), "text", ["The", "License"], ["doc_id"]).select("doc_id")


@query("with_document", "JN-01", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'")
def with_document(t):
    nodes = t.lineitem.select(F.col("l_orderkey").alias("doc"), "l_linenumber")
    docs = t.orders.select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("corpus"), "o_custkey")
    return R.with_document(nodes, docs, "1-URGENT").select(F.col("doc").alias("l_orderkey"), "l_linenumber", "o_custkey")


CANON = "e AS (SELECT DISTINCT p_name AS entity, CASE WHEN length(p_name) % 2 = 0 THEN length(p_name) * 3 ELSE -1 END AS canonical_node FROM part), n AS (SELECT p_partkey AS id, p_name AS entity FROM part)"


def _entities(t):
    size = F.length("p_name")
    return t.part.select(F.col("p_name").alias("entity"), F.when(size % 2 == 0, size * 3).otherwise(-1).alias("canonical_node")).distinct(), t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("entity"))


@query("canonical_nodes", "JN-03 JN-05 PRJ-04 GRF-10", f"WITH {CANON} SELECT entity, coalesce(max(c.id), min(n.id)) AS node FROM e LEFT JOIN n c ON c.id = canonical_node LEFT JOIN n USING (entity) GROUP BY entity".replace("coalesce(max(c.id), min(n.id)) AS node FROM e LEFT JOIN n c ON c.id = canonical_node LEFT JOIN n USING (entity) GROUP BY entity", "coalesce((SELECT id FROM n WHERE id = canonical_node), (SELECT min(id) FROM n WHERE n.entity = e.entity))::BIGINT AS node FROM e"))
def canonical_nodes(t):
    return R.canonical(*_entities(t)).withColumn("node", F.col("node").cast("long"))


@query("root_candidates", "JN-04", f"WITH {CANON} SELECT id FROM n WHERE id IN (SELECT coalesce(CASE WHEN l_quantity < 10 THEN l_partkey END, canonical_node) FROM lineitem JOIN part ON p_partkey = l_partkey LEFT JOIN e ON entity = p_name)")
def root_candidates(t):
    entities, nodes = _entities(t)
    anchors = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.when(F.col("l_quantity") < 10, F.col("l_partkey")).alias("node"), F.col("p_name").alias("entity"))
    return R.root_candidates(nodes, anchors, entities).select("id")


@query("stale_rows", "JN-07 SNK-10", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def stale_rows(t):
    return R.stale(t.customer.select("c_custkey"), t.orders.where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


OWNED = "SELECT DISTINCT m.id, m.doc, m.page, b.id AS owner, (b.x1 - b.x0) * (b.y1 - b.y0) AS area, length(name) AS len FROM marks m JOIN boxes b USING (doc, page) WHERE b.x0 - {s} <= m.x0 AND b.y0 - {s} <= m.y0 AND b.x1 + {s} >= m.x1 AND b.y1 + {s} >= m.y1"


def _owner_sql(slack, order, extra=""):
    return f"WITH {V.RECTS}, c AS ({OWNED.format(s=slack)}){extra} SELECT id, doc, page, owner FROM c QUALIFY row_number() OVER (PARTITION BY id, doc, page ORDER BY {order}, owner) = 1"


for _name, _preset, _sql in (
    ("owners_edges", "edges", _owner_sql(2, "area")),
    ("owners_cards", "cards", _owner_sql(0, "area")),
    ("owners_references", "references", _owner_sql(2, "len, area")),
    ("owners_projection", "projection", f"WITH {V.RECTS}, c AS ({OWNED.format(s=2)}), l AS (SELECT *, min(area) OVER (PARTITION BY id, doc, page) AS least FROM c) SELECT id, doc, page, min(owner) AS owner FROM l WHERE area - least < 0.01 GROUP BY id, doc, page HAVING count(*) = 1"),
):
    query(_name, "JN-08 GEO-01 EDG-02 EDG-09", _sql)(lambda t, p=_preset: R.owners(V.marks(t), V.boxes(t), p))

MEET = "m.doc = b.doc AND m.page = b.page AND b.x0 < m.x1 AND m.x0 < b.x1 AND b.y0 < m.y1 AND m.y0 < b.y1"


@query("uncovered_nodes", "JN-09", f"WITH {V.RECTS} SELECT id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM marks m WHERE {MEET} AND m.surface = 'N')")
def uncovered_nodes(t):
    return R.uncovered(V.boxes(t), V.marks(t).where("surface = 'N'")).select("id")


@query(
    "outermost_anchors",
    "JN-10",
    f"""WITH {V.CROWDED} SELECT a.id FROM boxes a WHERE NOT EXISTS (SELECT 1 FROM boxes b WHERE a.doc = b.doc AND a.page = b.page AND b.x0 - 1 <= a.x0 AND b.y0 - 1 <= a.y0 AND b.x1 + 1 >= a.x1 AND b.y1 + 1 >= a.y1
AND ((b.x1 - b.x0) * (b.y1 - b.y0) > (a.x1 - a.x0) * (a.y1 - a.y0) OR ((b.x1 - b.x0) * (b.y1 - b.y0) = (a.x1 - a.x0) * (a.y1 - a.y0) AND b.id < a.id)))""",
)
def outermost_anchors(t):
    return R.outermost(V.crowded(t).withColumn("surface", F.lit("same"))).select("id")


@query("previous_lemma", "JN-11 EDG-03", f"WITH {V.STATEMENTS} SELECT doc, n, last_value(CASE WHEN kind = 'lemma' THEN label END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM statements")
def previous_lemma(t):
    return R.before(V.statements(t), ["doc"], ["n"], "label", F.col("kind") == "lemma").select("doc", "n", "before")


@query(
    "last_definition",
    "JN-12",
    f"WITH {V.STATEMENTS}, d AS (SELECT * FROM statements WHERE kind = 'definition'), u AS (SELECT * FROM statements WHERE kind <> 'definition') SELECT u.doc, u.n AS src, max(d.n)::INT AS dst FROM u JOIN d ON u.doc = d.doc AND d.n < u.n GROUP BY ALL",
)
def last_definition(t):
    s = V.statements(t)
    uses = s.where("kind <> 'definition'").select("doc", F.col("n").alias("src"), F.col("n").alias("at"))
    return R.last_definition(uses, s.where("kind = 'definition'").select("doc", F.col("n").alias("dst"), F.col("n").alias("at")), ["doc"], "at")


@query("shared_symbols", "JN-13 EDG-06", "SELECT u.user_id, u.props AS sym, u.event_id AS src, max(d.event_id) AS dst FROM events u JOIN events d ON u.user_id = d.user_id AND u.props = d.props AND d.event_id < u.event_id AND d.event_type = 'signup' WHERE u.event_type <> 'signup' GROUP BY ALL")
def shared_symbols(t):
    e = t.events.select("user_id", F.col("props").alias("sym"), "event_id", "event_type")
    uses = e.where("event_type <> 'signup'").select("user_id", "sym", F.col("event_id").alias("src"), F.col("event_id").alias("at"))
    return R.last_definition(uses, e.where("event_type = 'signup'").select("user_id", "sym", F.col("event_id").alias("dst"), F.col("event_id").alias("at")), ["user_id", "sym"], "at")


@query(
    "title_mentions",
    "JN-14 EDG-04",
    """WITH n AS (SELECT DISTINCT source AS k, lang AS name, min(doc_id) AS dst FROM documents GROUP BY ALL), x AS (SELECT source AS k, doc_id AS src, text FROM documents)
SELECT k, src, name, dst FROM x JOIN n USING (k) WHERE src <> dst AND regexp_matches(' ' || text || ' ', '[^\\p{L}\\p{N}]' || name || '[^\\p{L}\\p{N}]')""",
)
def title_mentions(t):
    names = t.documents.groupBy(F.col("source").alias("k"), F.col("lang").alias("name")).agg(F.min("doc_id").alias("dst"))
    return R.mentions(t.documents.select(F.col("source").alias("k"), F.col("doc_id").alias("src"), "text"), names, "k")


@query("unique_names", "JN-15 RES-08", "SELECT p_name AS name, p_brand AS corpus, min(p_type) AS entity FROM part GROUP BY 1, 2 HAVING count(DISTINCT p_type) = 1")
def unique_names(t):
    return R.unique_names(t.part.select(F.col("p_name").alias("name"), F.col("p_brand").alias("corpus"), F.col("p_type").alias("entity")), ["name", "corpus"])


@query("same_statement", "JN-16 RES-10", "WITH g AS (SELECT lang, text, min(doc_id) AS first FROM documents WHERE length(text) > 0 GROUP BY ALL HAVING count(*) > 1) SELECT doc_id AS id, first, lang AS kind FROM documents JOIN g USING (lang, text) WHERE doc_id <> first")
def same_statement(t):
    return R.same_statement(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("text").alias("statement")))


@query("lookup", "JN-18", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup(t):
    return R.lookup(t.customer, t.nation.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey", ["n_name"]).select("c_custkey", "n_name")
