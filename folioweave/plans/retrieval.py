"""Queries of retrieval and resolution."""

from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import inverted_file as I
from ..operators import resolve as R
from ..operators import retrieval as S
from ..operators import segments as G
from ..operators import tables
from . import adapters as V
from .registry import query

WORDS = "list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))"
ASKED = "q AS (SELECT item_id AS q, text FROM benchmark)"


def _asked(t):
    return t.benchmark.select(F.col("item_id").alias("q"), "text")


def _docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


LEX = f"{ASKED}, d AS (SELECT doc_id AS id, unnest({WORDS}) AS w FROM documents), a AS (SELECT q, unnest({WORDS}) AS w FROM q), l AS (SELECT q, id, count(*) AS score FROM d JOIN a USING (w) GROUP BY ALL)"


@query("lexical_search", "RET-01 SRC-06 STR-08", f"WITH {LEX} SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INT AS rank FROM l QUALIFY rank <= 20")
def lexical_search(t):
    return S.lexical(_docs(t), _asked(t))


def _bm25_sql():
    field = lambda f, b: f"SELECT '{f}' AS field, {b} AS boost, id, {f} AS x FROM n"
    return f"""WITH {ASKED}, n AS (SELECT doc_id AS id, lang || ' ' || source AS title, text AS statement FROM documents), f AS ({field('title', 3.0)} UNION ALL {field('statement', 1.0)}),
w AS (SELECT field, boost, id, regexp_extract_all(lower(coalesce(x, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM f), z AS (SELECT field, count(*) AS n, avg(len(ws)) AS mean FROM w GROUP BY field),
p AS (SELECT field, boost, id, size, w, count(*) AS tf FROM (SELECT field, boost, id, len(ws) AS size, unnest(ws) AS w FROM w) GROUP BY ALL), a AS (SELECT q, unnest({WORDS}) AS w FROM q),
df AS (SELECT field, w, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT q, id, field, sum(boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))) AS s FROM a JOIN p USING (w) JOIN df USING (field, w) JOIN z USING (field) GROUP BY ALL),
m AS (SELECT q, id, max(s) AS score FROM s GROUP BY ALL) SELECT q, id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id)::INT AS rank FROM m QUALIFY rank <= 20"""


@query("bm25", "RET-02 RET-08 SNK-09", _bm25_sql())
def bm25(t):
    nodes = t.documents.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "lang", "source").alias("title"), F.col("text").alias("statement"))
    fields = ["title", "statement"]
    terms = _asked(t).select(F.explode(tokens(F.col("text"))).alias("w"))
    hits = S.bm25(S.counted(nodes, fields, terms), S.field_sizes(nodes, fields), _asked(t), {"title": 3.0, "statement": 1.0}, digits=9)
    return hits.select("q", "id", F.round("score", 6).alias("score"), "rank")


@query("segmented_bm25", "RET-08 SNK-09 SNK-10 RET-02", _bm25_sql())
def segmented_bm25(t):
    """An index that was filled with older texts and other nodes, then brought up to date and merged, scores as a fresh one does."""
    nodes = t.documents.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "lang", "source").alias("title"), F.col("text").alias("statement"))
    index = G.Segments(t.spark, f"{tables.folder(t.spark, 'segments')}", ["title", "statement"])
    index.add(nodes.where("title LIKE '%1%'").withColumn("statement", F.lit("an older text of the node")))
    index.add(nodes.unionByName(nodes.where("id % 3 = 0").withColumn("id", F.col("id") + 10**9)))
    index.keep_only(nodes)
    index.compact()
    return index.search(_asked(t), {"title": 3.0, "statement": 1.0}, digits=9).select("q", "id", F.round("score", 6).alias("score"), "rank")


KNN = "v AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS v, label FROM embeddings)"


@query("knn_label", "RET-03 JN-17 RES-01", f"WITH {KNN}, p AS (SELECT a.id AS q, b.id AS id, round(array_cosine_similarity(a.v, b.v), 9) AS score FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id) SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id)::INT AS rank FROM p QUALIFY rank <= 8")
def knn_label(t):
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return S.nearest(v, v.withColumnRenamed("id", "q"), 8, "label", digits=9)


@query("knn_inverted", "RET-03 JN-17 RES-01")
def knn_inverted(t):
    """Approximate, so without SQL: tested by its recall against all pairs, which comes with each row."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    found = I.nearest_listed(v, v.withColumnRenamed("id", "q"), 8, "label")
    return found.hits.withColumn("recall", F.lit(found.recall))


@query(
    "rank_fusion",
    "RET-04",
    f"""WITH {LEX}, one AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS r FROM l QUALIFY r <= 50), two AS (SELECT q, id, row_number() OVER (PARTITION BY q ORDER BY id) AS r FROM l WHERE score > 3 QUALIFY r <= 50),
s AS (SELECT q, id, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL) SELECT q, id, round(score, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, id)::INT AS rank FROM s QUALIFY rank <= 20""",
)
def rank_fusion(t):
    one = S.lexical(_docs(t), _asked(t), 50)
    from pyspark.sql import Window

    all_ = S.overlap(_docs(t), _asked(t)).where("score > 3").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy("id"))).where("rank <= 50")
    hits = S.fused([one, all_], 100).drop("rank").withColumn("score", F.round("score", 9))
    return S.ranked(hits, ["q"], 20)


@query(
    "expansion_gate",
    "RET-05 RET-01",
    f"""WITH h AS (SELECT list(DISTINCT w) AS known FROM (SELECT unnest({WORDS.replace('text', 'p_name')}) AS w FROM part))
SELECT conv_id, turn, length(text) <= 80 AND len(string_split_regex(trim(text, ' '), '\\s+')) <= 5 AND len(list_intersect({WORDS}, known)) = 0 AS expand FROM conversations, h""",
)
def expansion_gate(t):
    """Turns as queries against the names of parts: those without any hit may be expanded."""
    asked = t.conversations.select(F.struct("conv_id", "turn").alias("q"), "conv_id", "turn", "text")
    names = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))
    hits = S.overlap(names, asked.select("q", "text")).groupBy("q").agg(F.count("*").alias("hits"))
    return asked.join(hits, "q", "left").select("conv_id", "turn", S.wants_expansion(F.col("text"), F.coalesce("hits", F.lit(0))).alias("expand"))


@query("fan_out", "RET-07 RET-06", f"WITH {LEX}, c AS (SELECT q, l.id, score, source AS corpus FROM l JOIN documents ON doc_id = l.id) SELECT q, corpus, id, score, row_number() OVER (PARTITION BY q, corpus ORDER BY score DESC, id)::INT AS rank FROM c QUALIFY rank <= 5")
def fan_out(t):
    hits = S.overlap(_docs(t), _asked(t)).join(t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("corpus")), "id")
    return S.fan_out(S.checked_scope(hits, t.documents.select(F.col("source").alias("corpus"))), 5).select("q", "corpus", "id", "score", "rank")


LINKS = "links AS (SELECT DISTINCT a.c_custkey AS a, a.c_nationkey * 60 + b.s_suppkey % 60 AS b FROM customer a JOIN supplier b ON b.s_suppkey = a.c_custkey % 97)"


@query(
    "components",
    "RES-03",
    f"WITH RECURSIVE {LINKS}, k AS (SELECT a, b FROM links WHERE b IN (SELECT c_custkey FROM customer)), e AS (SELECT a, b FROM k UNION SELECT b, a FROM k), r AS (SELECT c_custkey AS id, c_custkey AS x FROM customer UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a) SELECT id, min(x) AS root FROM r GROUP BY id",
)
def components(t):
    a = t.customer.join(t.supplier, F.col("s_suppkey") == F.col("c_custkey") % 97)
    links = a.select(F.col("c_custkey").alias("a"), (F.col("c_nationkey") * 60 + F.col("s_suppkey") % 60).alias("b"))
    known = t.customer.select(F.col("c_custkey").alias("id"))
    return R.components(known, links.join(known.withColumnRenamed("id", "b"), "b", "left_semi"))


def _plan(t):
    nodes = t.embeddings.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 50 == 0, F.concat(F.lit("e"), F.col("vec_id").cast("string"))).alias("entity"), F.concat(F.lit("n"), F.col("label").cast("string")).alias("name"))
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    near = S.nearest(v, v.withColumnRenamed("id", "q"), 3, "label", digits=9)
    # Near vectors are the same; those a little farther apart are surely not, which stops the components that they stand in.
    verdict = F.when(F.col("score") >= 0.3, "same").when(F.col("label") % 2 == 0, "specialisation").otherwise("different")
    confidence = F.when(F.col("score") >= 0.3, F.least(F.lit(1.0), F.col("score") + 0.5)).when(F.col("score") >= 0.29, 0.9).otherwise(0.5)
    labelled = near.join(t.embeddings.select(F.col("vec_id").alias("q"), "label"), "q")
    return R.plan(nodes, labelled.select(F.col("q").alias("node"), F.col("id").alias("candidate"), verdict.alias("verdict"), confidence.alias("confidence")))


#: Existing entities are one node each here, so nothing is joined before the decisions.
PLAN = f"""{KNN}, n AS (SELECT id, CASE WHEN id % 50 = 0 THEN 'e' || id END AS entity FROM v),
d AS MATERIALIZED (SELECT q AS node, id AS candidate, CASE WHEN score >= 0.3 THEN 'same' WHEN label % 2 = 0 THEN 'specialisation' ELSE 'different' END AS verdict, CASE WHEN score >= 0.3 THEN least(1.0::DOUBLE, score + 0.5) WHEN score >= 0.29 THEN 0.9 ELSE 0.5 END::DOUBLE AS confidence
  FROM (SELECT a.id AS q, b.id AS id, a.label, round(array_cosine_similarity(a.v, b.v), 9) AS score FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(array_cosine_similarity(a.v, b.v), 9) DESC, b.id) <= 3)),
one AS MATERIALIZED (SELECT node AS a, candidate AS b FROM d WHERE verdict = 'same' AND confidence >= 0.8), l1 AS (SELECT a, b FROM one UNION SELECT b, a FROM one),
r1 AS (SELECT id, id AS x FROM n UNION SELECT r1.id, l1.b FROM r1 JOIN l1 ON r1.x = l1.a), j AS MATERIALIZED (SELECT id, min(x) AS root FROM r1 GROUP BY id),
stopped AS MATERIALIZED (SELECT id FROM j WHERE root IN (SELECT a.root FROM d JOIN j a ON a.id = node JOIN j b ON b.id = candidate WHERE verdict <> 'same' AND confidence >= 0.8 AND a.root = b.root)),
final AS MATERIALIZED (SELECT node, candidate, verdict, CASE WHEN verdict = 'same' AND confidence >= 0.8 AND node IN (SELECT id FROM stopped) AND candidate IN (SELECT id FROM stopped) THEN 0.0 ELSE confidence END AS confidence FROM d),
two AS MATERIALIZED (SELECT node AS a, candidate AS b FROM final WHERE verdict = 'same' AND confidence >= 0.8), l2 AS (SELECT a, b FROM two UNION SELECT b, a FROM two),
r2 AS (SELECT id, id AS x FROM n UNION SELECT r2.id, l2.b FROM r2 JOIN l2 ON r2.x = l2.a), k AS (SELECT id, min(x) AS root FROM r2 GROUP BY id),
g AS (SELECT root, min(entity) AS entity, sha256(root::VARCHAR) AS h FROM k JOIN n USING (id) GROUP BY root)"""


@query(
    "resolution",
    "RES-04 RES-05 RES-06",
    f"WITH RECURSIVE {PLAN} SELECT id, coalesce(entity, h[1:8] || '-' || h[9:12] || '-' || h[13:16] || '-' || h[17:20] || '-' || h[21:32]) AS entity FROM k JOIN g USING (root)",
)
def resolution(t):
    return _plan(t)["assignments"]


@query(
    "resolution_edges",
    "RES-06 JN-16",
    f"WITH RECURSIVE {PLAN} SELECT node AS src, candidate AS dst, CASE verdict WHEN 'same' THEN 'restates' ELSE 'specialises' END AS kind, confidence FROM final WHERE confidence >= 0.8 AND verdict IN ('same', 'specialisation')",
)
def resolution_edges(t):
    return _plan(t)["edges"]


@query(
    "decision_contract",
    "RES-02",
    "WITH p AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS candidate FROM lineitem WHERE l_quantity < 20), d AS (SELECT l_partkey AS node, l_suppkey AS candidate, count(*) AS n FROM lineitem WHERE l_quantity < 25 AND l_discount > 0.02 GROUP BY ALL), b AS (SELECT node, candidate, CASE WHEN p.node IS NULL THEN 'not asked' WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN d.node = d.candidate THEN 'itself' END AS why FROM p FULL JOIN d USING (node, candidate)) SELECT * FROM b WHERE why IS NOT NULL",
)
def decision_contract(t):
    pick = lambda c: t.lineitem.where(c).select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("candidate"))
    return R.checked_decisions(pick("l_quantity < 20"), pick("l_quantity < 25 AND l_discount > 0.02"))


@query("evidence", "RES-09", "SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g'), ' '), trim(regexp_replace(b.text, '\\s+', ' ', 'g'), ' ')) WHERE length(b.text) >= 16")
def evidence(t):
    # Items are the stated queries, against all documents.
    return R.evidenced(t.benchmark.select("item_id", F.col("text").alias("evidence")), t.documents.select("doc_id", "text"))


#: Pairs of one task, and parts of a block that meets all of its brand and size.
PAIRS_A_TASK, PARTS_A_BLOCK = 4_000_000, 1000


@query("adjudicated", "UDF-02 UDF-03 UDF-04", "SELECT a.p_partkey AS a, b.p_partkey AS b, CASE WHEN a.p_name = b.p_name THEN 'same' ELSE 'different' END AS verdict FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def adjudicated(t):
    """All pairs of parts of a brand and size; asked twice, and the second time all answers come from the cache."""
    group = ["p_brand", "p_size"]
    # Pairs grow with the square of a group and parts are few bytes: tasks go by the number of pairs, and a group's parts are dealt into blocks.
    n = t.part.groupBy(*group).count().agg(F.max("count").alias("most"), F.sum(F.col("count") * F.col("count")).alias("met")).first()
    blocks = -(-(n["most"] or 0) // PARTS_A_BLOCK) or 1
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-(n["met"] or 0) // (2 * PAIRS_A_TASK)))
    one = t.part.select(*group, F.col("p_partkey").alias("a"), F.col("p_name").alias("left"), F.pmod(F.xxhash64("p_partkey"), F.lit(blocks)).cast("int").alias("_x"))
    two = t.part.select(*group, F.col("p_partkey").alias("b"), F.col("p_name").alias("right"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_x"))
    pairs = one.repartition(tasks, *group, "_x").hint("merge").join(two.repartition(tasks, *group, "_x"), [*group, "_x"]).where("a < b").drop("_x")
    # Two names of a group are asked for if a part of the one comes before a part of the other, so copies of names make no pairs here.
    names = t.part.groupBy(*group, "p_name").agg(F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    texts = names.select(*group, F.col("p_name").alias("left"), "low").join(names.select(*group, F.col("p_name").alias("right"), "high"), group).where("low < high").select("left", "right")
    cache = tables.folder(t.spark, "answers")
    R.adjudicated(pairs, lambda x, y: ("same" if x == y else "different", 1.0), limit=3, cache=cache, texts=texts)
    again = R.adjudicated(pairs, lambda x, y: ("asked again", 0.0), limit=3, cache=cache, texts=texts)
    return again.select("a", "b", "verdict")
