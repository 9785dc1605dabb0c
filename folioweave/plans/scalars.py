"""Queries of scalar functions, cards, the ledger and constraints."""

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as S
from ..operators import cards as C
from ..operators import graph as G
from ..operators import ledger as L
from . import adapters as V
from .graph import WALK
from .registry import query


@query("normalised_text", "STR-01 STR-02", "SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[‐‑–—]', '-', 'g'), '\\s+', ' ', 'g'), ' ') AS t FROM documents")
def normalised_text(t):
    return t.documents.select("doc_id", S.normalised(F.col("text")).alias("t"))


@query("mentioned", "STR-03 STR-04", "SELECT doc_id, regexp_matches(' ' || text || ' ', '[^\\p{L}\\p{N}]the([^\\p{L}\\p{N}.]|\\.[^0-9])') AS hit FROM documents")
def mentioned(t):
    return t.documents.select("doc_id", S.mentioned(F.col("text"), F.lit("the")).alias("hit"))


@query("statement_body", "STR-05 STR-06", f"WITH {V.STATEMENTS} SELECT doc, n, CASE WHEN n % 2 = 0 THEN '' ELSE '(' || title || ') ' END || body AS text, body FROM statements".replace("CASE WHEN n % 2 = 0 THEN '' ELSE '(' || title || ') ' END || body AS text, ", ""))
def statement_body(t):
    s = V.statements(t).withColumn("title", F.when(F.col("n") % 2 == 1, F.col("title")))
    whole = F.concat_ws(" ", "label", F.concat(F.lit("("), "title", F.lit(")")), "body")
    return s.select("doc", "n", S.body(whole, F.col("label"), F.col("title")).alias("body"))


@query("readable_notation", "STR-07", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' dim x' || chr(10) || 'Readable notation: ' || p_name || ' dimension x' ELSE p_name || ' dimx' END AS t FROM part")
def readable_notation(t):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" dim x"))).otherwise(F.concat("p_name", F.lit(" dimx")))
    return t.part.select("p_partkey", S.readable(raw).alias("t"))


@query("substituted", "STR-09", "SELECT p_partkey, 'Let y be p_x and ' || p_name || ' of x, exp, x_1.' AS t FROM part".replace("p_x", "\\\\x".replace("\\\\", "\\")))
def substituted(t):
    return t.part.select("p_partkey", S.substituted(F.concat(F.lit("Let x be \\x and "), "p_name", F.lit(" of y, exp, x_1.")), F.create_map(F.lit("x"), F.lit("y"), F.lit("y"), F.lit("x"))).alias("t"))


LABELS = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN 'Theorem ' || doc_id ELSE (CASE WHEN e = '' THEN 'Theorem · p. 1' ELSE 'Theorem: ' || CASE WHEN length(e) > 64 THEN rtrim(e[:61], ' ') || '…' ELSE e END END) END AS label FROM (SELECT *, trim(regexp_replace(regexp_replace(trim(coalesce(text, ''), ' '), '[$*_`#]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS e FROM documents)"


@query("node_labels", "STR-10 STR-13", LABELS)
def node_labels(t):
    i = F.col("doc_id")
    title = F.when(i % 3 == 0, F.col("source")).otherwise("none")
    head = F.when(i % 3 == 1, F.concat(F.lit("Theorem "), i.cast("string"))).otherwise("theorem")
    return t.documents.select("doc_id", S.node_label(title, head, F.lit("theorem"), F.col("text"), F.lit(1)).alias("label"))


@query("card_rows", "STR-11 SNK-12", "SELECT p_partkey, '\"' || replace(p_name, '\"', '\"\"') || ' &lt;b&gt;\",\"\\(x\\)<br>' || p_brand || '\"' AS line FROM part")
def card_rows(t):
    front = S.csv_field(S.escaped(F.concat("p_name", F.lit(" <b>"))))
    back = S.csv_field(S.card_html(F.concat(F.lit("$x$\n"), "p_brand")))
    return t.part.select("p_partkey", F.concat_ws(",", front, back).alias("line"))


@query("occurs_once", "STR-12", "SELECT doc_id, len(string_split(text, 'tion')) = 2 AS once FROM documents WHERE text IS NOT NULL")
def occurs_once(t):
    return t.documents.where("text IS NOT NULL").select("doc_id", S.occurs_once(F.col("text"), F.lit("tion")).alias("once"))


@query("span_style", "STR-14 STR-15", "SELECT p_partkey, (p_size & 16) <> 0 OR p_type LIKE '%PROMO%' AS bold, (p_size & 2) <> 0 AS italic, p_brand AS stem FROM part")
def span_style(t):
    font = F.when(F.col("p_type") == "PROMO", "Times-Bold").otherwise("Times")
    return t.part.select("p_partkey", S.is_bold(font, F.col("p_size")).alias("bold"), S.is_italic(font, F.col("p_size")).alias("italic"), S.stem(F.concat(F.lit("/in/x.y/"), "p_brand", F.lit(".pdf"))).alias("stem"))


@query("geometry", "GEO-01 GEO-02 GEO-03 GEO-04", f"WITH {V.RECTS} SELECT id, (x1 - x0) * (y1 - y0) AS area, round(x1 * 1.5, 6)::DOUBLE AS x1, round(greatest(0.0, (least(y1, 400) - greatest(y0, 100)) / (y1 - y0)), 6)::DOUBLE AS seen, round(4 + sqrt(page) * 28, 6) AS radius FROM boxes")
def geometry(t):
    b = V.boxes(t).withColumn("box", F.struct("x0", "y0", "x1", "y1"))
    seen = N.visible_share(F.col("y0"), F.col("y1"), F.lit(100), F.lit(400))
    return b.select("id", N.area(F.col("box")).alias("area"), F.round(N.scaled(F.col("box"), F.lit(1.5))["x1"], 6).alias("x1"), F.round(seen, 6).alias("seen"), F.round(N.radius(F.col("page")), 6).alias("radius"))


PRICES = "VALUES ('A', 0.2, 0.02, 0.25, 1.2, 300), ('N', 4.0, 0.4, 5.0, 20.0, NULL)"


@query(
    "priced_calls",
    "NUM-01 NUM-02 DQ-04",
    f"""WITH p(model, i, c, w, o, most) AS ({PRICES}), k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag AS model, l_partkey % 400 AS total, l_suppkey % 90 AS cached, 3 AS writes, l_linenumber AS output FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN i IS NULL THEN 'unknown model' WHEN total - cached - writes < 0 THEN 'invalid usage' WHEN total > most THEN 'long context' END AS why,
CASE WHEN i IS NOT NULL AND total - cached - writes >= 0 AND (most IS NULL OR total <= most) THEN round(((total - cached - writes) * i + cached * c + writes * w + output * o)::DOUBLE / 1000000, 9) END AS cost FROM k LEFT JOIN p USING (model)""",
)
def priced_calls(t):
    calls = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("model"), (F.col("l_partkey") % 400).alias("total"), (F.col("l_suppkey") % 90).alias("cached"), F.lit(3).alias("writes"), F.col("l_linenumber").alias("output"))
    prices = t.spark.createDataFrame([("A", 0.2, 0.02, 0.25, 1.2, 300), ("N", 4.0, 0.4, 5.0, 20.0, None)], "model string, p_input double, p_cached double, p_write double, p_output double, most_input long")
    return L.priced(calls, prices).select("l_orderkey", "l_linenumber", "l_partkey", "why", F.round("cost", 9).alias("cost"))


@query("content_hashes", "HSH-01", "SELECT p_partkey, sha256('{\"p_name\":\"' || p_name || '\",\"p_size\":' || p_size || '}') AS h FROM part")
def content_hashes(t):
    return t.part.select("p_partkey", N.content_hash("p_name", "p_size").alias("h"))


@query("stable_ids", "HSH-02", "SELECT p_partkey, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32] AS id FROM (SELECT p_partkey, sha256(p_brand || ':' || p_name) AS h FROM part)")
def stable_ids(t):
    return t.part.select("p_partkey", N.stable_id("p_brand", "p_name").alias("id"))


@query("page_links", "ARR-01 AGG-13", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query("vector_checks", "ARR-02 ARR-04", "SELECT vec_id, len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok, len(list_filter(embedding, lambda x: x > 0.3)) > 0 AS far FROM embeddings")
def vector_checks(t):
    return t.embeddings.select("vec_id", N.usable_vector(F.col("embedding"), 64).alias("ok"), F.exists("embedding", lambda x: x > 0.3).alias("far"))


@query("json_values", "JSN-01 FLT-04", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, '{\"t\":\"' || event_type || '\"}' AS j FROM events WHERE coalesce(json_extract_string(props, '$.synthetic'), 'false') <> 'true'")
def json_values(t):
    keep = F.coalesce(F.get_json_object("props", "$.synthetic"), F.lit("false")) != "true"
    return t.events.where(keep).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"), F.to_json(F.struct(F.col("event_type").alias("t"))).alias("j"))


@query("contexts", "CRD-01 STR-12", f"WITH {V.RECTS} SELECT m.id, m.doc, b.id AS owner FROM marks m JOIN boxes b USING (doc, page) WHERE b.x0 <= m.x0 AND b.y0 <= m.y0 AND b.x1 >= m.x1 AND b.y1 >= m.y1 AND b.id % 3 <> 0 AND len(string_split(name || ' N.', surface)) = 2 QUALIFY row_number() OVER (PARTITION BY m.id ORDER BY (b.x1 - b.x0) * (b.y1 - b.y0), b.id) = 1".replace("m.id, m.doc, b.id", "m.id, b.id"))
def contexts(t):
    symbol = lambda s, r: F.struct(F.lit(s).alias("sym"), F.lit(r).alias("role"))
    nodes = V.boxes(t).withColumn("statement", F.concat("name", F.lit(" N."))).withColumn("symbols", F.when(F.col("id") % 3 == 0, F.array(symbol("x", "a"), symbol("x", "b"))).otherwise(F.array(symbol("x", "a"))))
    return C.contexts(V.marks(t), nodes).select("id", "owner")


@query("grounded_rewrites", "CRD-02 CRD-03 STR-09", "SELECT p_partkey, p_size % 4 = 0 AS valid, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'invalid-output' END AS mode FROM part")
def grounded_rewrites(t):
    k = F.col("p_size") % 4
    rows = t.part.select(
        "p_partkey",
        F.lit("Let T map V to W.").alias("statement"),
        F.lit("Take S on U, then S is fine.").alias("paragraph"),
        F.array(F.lit("i")).alias("clauses"),
        F.array(F.lit("T"), F.lit("V")).alias("symbols"),
        F.array(F.lit("S"), F.lit("U"), F.lit("V")).alias("local"),
        F.when(k == 1, F.array(F.lit("ii"))).otherwise(F.array(F.lit("i"))).alias("clause_ids"),
        F.when(k == 2, F.array(F.struct(F.lit("T").alias("from"), F.lit("V").alias("to")))).otherwise(F.array(F.struct(F.lit("T").alias("from"), F.lit("S").alias("to")))).alias("subs"),
        F.when(k == 3, "Let T map V to W.").otherwise("Let S map V to W.").alias("rewritten"),
        F.lit("fine").alias("gloss"),
    )
    out = C.grounded(rows)
    return out.select("p_partkey", "valid", C.card_mode(F.lit(True), F.lit(True), F.lit(False), F.col("valid")).alias("mode"))


@query("fallback_cards", "CRD-04", "SELECT o_orderkey AS id, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'own' END, c_name) AS headline, o_orderstatus = 'F' AS baked FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_nationkey < 12 WHERE o_orderstatus = 'F' OR c_name IS NOT NULL")
def fallback_cards(t):
    anchors = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("x").alias("corpus"), F.col("o_custkey").alias("target"))
    cards = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), F.lit("own").alias("headline"), F.lit("b").alias("body"))
    nodes = t.customer.select(F.col("c_custkey").alias("target"), F.when(F.col("c_nationkey") < 12, "x").otherwise("y").alias("corpus"), F.col("c_name").alias("headline"), F.col("c_mktsegment").alias("body"))
    return C.with_fallback(anchors, cards, nodes).select("id", "headline", "baked")


@query("pending_documents", "CRD-05", "SELECT DISTINCT l_orderkey AS doc FROM lineitem WHERE l_discount < 0.02 AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) AND l_orderkey <> 5")
def pending_documents(t):
    anchors = t.lineitem.select(F.col("l_orderkey").alias("doc"), F.col("l_partkey").alias("entity"), F.when(F.col("l_discount") >= 0.02, F.col("l_partkey")).alias("target"))
    return C.pending(anchors, t.part.where("p_size = 7").select(F.col("p_partkey").alias("entity")), 5)


@query(
    "viewport_answer",
    "VOI-01 LIM-02",
    f"""WITH RECURSIVE {WALK}, s AS (SELECT request, depth, place, node, p_name || ' ' || p_brand AS statement FROM hops JOIN part ON node = p_partkey WHERE p_type <> 'PROMO' QUALIFY row_number() OVER (PARTITION BY request, p_name ORDER BY depth, place, node) = 1),
n AS (SELECT request, (row_number() OVER (PARTITION BY request ORDER BY depth, place, node))::INT AS rank, CASE WHEN length(statement) > 1000 THEN '[too long]' ELSE statement END AS shown FROM s),
u AS (SELECT *, sum(length(shown)) OVER (PARTITION BY request ORDER BY rank)::BIGINT AS used FROM n WHERE rank <= 3) SELECT request, rank, shown, used FROM u WHERE used <= 1000""",
)
def viewport_answer(t):
    roots = t.part.orderBy(F.desc("p_retailprice"), "p_partkey").limit(3).select(F.lit(1).cast("long").alias("request"), F.col("p_partkey").alias("id"))
    hops = G.trace_bfs(V.edges(t), roots, simple=True)
    kind = F.when(F.col("p_type") == "PROMO", "proof").otherwise("theorem")
    nodes = t.part.select(F.col("p_partkey").alias("node"), kind.alias("kind"), F.col("p_name").alias("identity"), F.concat_ws(" ", "p_name", "p_brand").alias("statement"))
    return C.answer(hops, nodes)


@query("upserted_cards", "SNK-05", "SELECT coalesce(o_orderkey, k) AS anchor, coalesce(n.v, o.o_orderpriority) AS v, coalesce(n.v IS NOT NULL AND (o.o_orderpriority IS NULL OR n.v <> o.o_orderpriority), false) AS changed FROM (SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F') o FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_totalprice > 200000 THEN 'new' ELSE o_orderpriority END AS v FROM orders WHERE o_orderpriority <> '5-LOW') n ON k = o_orderkey")
def upserted_cards(t):
    cards = t.orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("anchor"), F.col("o_orderpriority").alias("v"))
    new = t.orders.where("o_orderpriority <> '5-LOW'").select(F.col("o_orderkey").alias("anchor"), F.when(F.col("o_totalprice") > 200000, "new").otherwise(F.col("o_orderpriority")).alias("v"))
    return C.upserted(cards, new)


#: Events one by one: `open` has each reserved id with its amount, null once it is settled.
BUDGET = """e AS MATERIALIZED (SELECT user_id, event_id AS "at", event_id % 5 AS id, CASE WHEN event_type IN ('click', 'view') THEN 'reserve' ELSE 'settle' END AS kind, floor(value * 100)::BIGINT AS amount, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
b AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS "at", NULL::BIGINT AS id, '' AS kind, NULL::BIGINT AS amount, '' AS outcome, 0::BIGINT AS committed, true AS enabled, []::STRUCT(id BIGINT, most BIGINT)[] AS open FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL SELECT user_id, k, "at", id, kind, amount, outcome, CASE outcome WHEN 'reserved' THEN committed + amount WHEN 'settled' THEN committed + amount - most WHEN 'overrun' THEN committed + amount - most ELSE committed END,
    enabled AND outcome <> 'overrun',
    CASE WHEN outcome = 'reserved' THEN list_append(open, {'id': id, 'most': amount}) WHEN outcome IN ('settled', 'overrun') THEN list_append(list_filter(open, lambda x: x.id <> id), {'id': id, 'most': NULL}) ELSE open END
  FROM (SELECT *, CASE WHEN kind = 'reserve' THEN CASE WHEN NOT enabled THEN 'disabled' WHEN amount <= 0 OR known THEN 'invalid' WHEN committed + amount > 100000 THEN 'refused' ELSE 'reserved' END
      WHEN most IS NULL OR amount < 0 THEN 'invalid' WHEN amount > most THEN 'overrun' ELSE 'settled' END AS outcome
    FROM (SELECT e.user_id, e.k, e."at", e.id, e.kind, e.amount, b.committed, b.enabled, b.open, len(list_filter(b.open, lambda x: x.id = e.id)) > 0 AS known, (list_filter(b.open, lambda x: x.id = e.id))[1].most AS most FROM b JOIN e ON b.user_id = e.user_id AND e.k = b.k + 1)))"""


@query(
    "colours",
    "HSH-03",
    """WITH d AS (SELECT DISTINCT p_type AS set, p_name AS id FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY set ORDER BY id) - 1 AS place, min(id) OVER (PARTITION BY set) AS first FROM d),
h AS (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(first, ''), lambda c: ord(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM r)
SELECT set, id, CASE WHEN place < 8 THEN ['#DB935F', '#6CACE4', '#80BD98', '#BC99DD', '#E0B45A', '#E58DA0', '#67C4C3', '#B3BF75'][(h + place) % 8 + 1] ELSE 'hsl(' || round((h % 360 + place * 137.508) % 360, 3)::DECIMAL(6, 3) || ' 50% 68%)' END AS colour FROM h""",
)
def colours(t):
    from pyspark.sql import Window

    docs = t.part.select(F.col("p_type").alias("set"), F.col("p_name").alias("id")).distinct()
    of_set = Window.partitionBy("set")
    placed = docs.withColumn("place", F.row_number().over(of_set.orderBy("id")) - 1).withColumn("first", F.min("id").over(of_set))
    return placed.select("set", "id", N.colour(F.col("first"), F.col("place")).alias("colour"))


@query("budget_log", "STM-05 UDF-01", f"WITH RECURSIVE {BUDGET} SELECT user_id, \"at\", id, kind, amount, outcome, committed FROM b WHERE k > 0")
def budget_log(t):
    e = t.events.select("user_id", F.col("event_id").alias("at"), (F.col("event_id") % 5).alias("id"), F.when(F.col("event_type").isin("click", "view"), "reserve").otherwise("settle").alias("kind"), F.floor(F.col("value") * 100).alias("amount"))
    return L.budget_log(e, "user_id", 100_000)


@query(
    "integrity",
    "DQ-01 DQ-02 DQ-03 SNK-08",
    """SELECT 'customer' AS rule, o_orderkey::VARCHAR AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION ALL SELECT 'price', o_orderkey::VARCHAR FROM orders WHERE NOT o_totalprice < 490000 UNION ALL SELECT 'line', l_orderkey::VARCHAR FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""",
)
def integrity(t):
    lines = L.repeated(t.lineitem, ["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("o_orderkey"))
    return L.violations({"customer": L.missing_reference(t.orders, "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey"), "price": L.outside(t.orders, F.col("o_totalprice") < 490000), "line": lines}, "o_orderkey")


@query("retry_eligible", "STM-07 STM-06", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1000")
def retry_eligible(t):
    docs = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "error").otherwise("ready").alias("status"), (F.col("o_totalprice") > 1000).alias("stored"))
    return L.retry_eligible(docs).select("o_orderkey")
