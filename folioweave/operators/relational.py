"""Projections, filters and joins of the graph model (PRJ, FLT, JN). Every join has an equality key; boxes meet by tiles (spatial), patterns are residual conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import spatial


def summary(nodes: DataFrame) -> DataFrame:
    """PRJ-01, PRJ-02, PRJ-05: the columns of a node summary, its source as a struct, a headline that skips null only; large columns go (PRJ-03)."""
    headline = F.coalesce("title", "label", "kind")
    return nodes.select("id", "kind", headline.alias("headline"), F.struct(F.col("doc").alias("doc_id"), "page").alias("source"))


def scoped_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """FLT-01, JN-02: edges whose ends both stand in one corpus."""
    a, b = nodes.select(F.col("id").alias("src"), F.col("corpus").alias("corpus")), nodes.select(F.col("id").alias("dst"), F.col("corpus").alias("_other"))
    return edges.join(a, "src").join(b, "dst").where(F.col("corpus") == F.col("_other")).drop("_other")


def optional(df: DataFrame, column: str, value) -> DataFrame:
    """FLT-02: a filter that None turns off."""
    return df if value is None else df.where(F.col(column) == value)


def quality_gate(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """FLT-07: documents under the least quality are unsupported."""
    return docs.withColumn("status", F.when(F.col("quality") >= least, "ready").otherwise("unsupported"))


def in_scope(ledger: DataFrame, corpus: Column, docs: DataFrame, doc: str, other: Column) -> DataFrame:
    """FLT-05: rows of the corpus, or of one of its documents, or that another mark names."""
    known = docs.select(F.col("doc").alias("_d")).distinct().withColumn("_in", F.lit(True))
    return ledger.join(known, F.col(doc) == F.col("_d"), "left").where(corpus | F.coalesce("_in", F.lit(False)) | other).drop("_d", "_in")


def checked_limit(limit: int, least: int = 1, most: int = 100) -> int:
    """FLT-06: a limit in its range."""
    if not least <= limit <= most:
        raise ValueError(f"limit must be {least} to {most}")
    return limit


def weak_spots(nodes: DataFrame, state: DataFrame, least: int = 3) -> DataFrame:
    """FLT-08: nodes that a reader hovered over often; unknown ones count zero."""
    return nodes.join(state, "id", "left").where(F.coalesce("hover_count", F.lit(0)) >= least)


def contains_text(df: DataFrame, columns: list[str], text: str) -> DataFrame:
    """FLT-09: rows where any column contains the text, whatever the case."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
    return df.where(hit)


def contains_all(df: DataFrame, column: str, words: list[str], order: list[str], limit: int = 20) -> DataFrame:
    """FLT-10: rows that contain every word, the first `limit` in order."""
    for w in words:
        df = df.where(F.lower(column).contains(w.lower()))
    return df.orderBy(*order).limit(limit)


def with_document(nodes: DataFrame, docs: DataFrame, corpus: str) -> DataFrame:
    """JN-01: nodes of the documents of a corpus."""
    return nodes.join(docs.where(F.col("corpus") == corpus), "doc")


def canonical(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """JN-03, JN-05, PRJ-04, GRF-10: each entity's canonical node, else its smallest one."""
    least = nodes.where("entity IS NOT NULL").groupBy("entity").agg(F.min("id").alias("_least"))
    there = nodes.select(F.col("id").alias("canonical_node"))
    kept = entities.join(there, "canonical_node", "left_semi").select("entity", "canonical_node")
    return entities.select("entity").join(kept, "entity", "left").join(least, "entity", "left").select("entity", F.coalesce("canonical_node", "_least").alias("node"))


def root_candidates(nodes: DataFrame, anchors: DataFrame, entities: DataFrame) -> DataFrame:
    """JN-04: nodes that an anchor targets, directly or by its entity's canonical node."""
    target = anchors.join(entities, "entity", "left").select(F.coalesce("node", "canonical_node").alias("id")).where("id IS NOT NULL")
    return nodes.join(target, "id", "left_semi")


def stale(index: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """JN-07: rows of the index whose key is gone."""
    return index.join(current, keys, "left_anti")


PRESETS = {
    #: slack, order among containing boxes, whether equal best ones give none.
    "edges": (2, ["area", "id"], False),
    "projection": (2, ["area", "id"], True),
    "cards": (0, ["area", "id"], False),
    "references": (2, ["length", "area", "id"], False),
}


def owners(anchors: DataFrame, nodes: DataFrame, preset: str = "edges") -> DataFrame:
    """JN-08, GEO-01: the node whose box contains an anchor's, on the same page of the same document: the smallest one by the preset. anchors and nodes: id, doc, page, x0..y1; nodes: name. Boxes meet by tiles; of equal boxes only those that may win go on."""
    slack, order, reject = PRESETS[preset]
    box = ["doc", "page", *spatial.BOX]
    rank = {"area": F.col("_area"), "id": F.col("owner"), "length": F.col("_length")}
    # Copies of a box: the best one stands for all, with the number of those that tie with it.
    best_of = F.min(F.struct(F.length("name").alias("_length"), F.col("id").alias("owner")) if "length" in order else F.struct(F.col("id").alias("owner"), F.length("name").alias("_length"))).alias("_b")
    n = nodes.groupBy(*box).agg(best_of, F.countDistinct("id").alias("_copies")).select(*box, "_b.owner", "_b._length", "_copies")
    # One struct minimum, pre-aggregated, instead of a window over all boxes around an anchor.
    found = spatial.containing(anchors.select("id", *box), n, ["doc", "page"], slack)
    if reject:
        # Only those that tie with the least area go on, so boxes meet once.
        least = F.min("_area").over(Window.partitionBy("id", "doc", "page"))
        found = found.withColumn("_least", least).where(F.abs(F.col("_area") - F.col("_least")) < 0.01)
    best = found.groupBy("id", "doc", "page").agg(F.min(F.struct(*[rank[o].alias(o) for o in order], F.col("owner").alias("owner"))).alias("b"), F.min("owner").alias("low"), F.max("owner").alias("high"), F.max("_copies").alias("copies"))
    if reject:
        best = best.where("low = high AND copies = 1")
    return best.select("id", "doc", "page", F.col("b.owner").alias("owner"))


def uncovered(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """JN-09: nodes that no anchor of their page overlaps. What covers a box covers its copies, so each box is asked for once."""
    box = ["doc", "page", *spatial.BOX]
    hit = spatial.overlapping(nodes.select(*box).distinct(), anchors.select(*box).distinct(), ["doc", "page"]).select(*box).distinct()
    return nodes.join(hit, box, "left_anti")


def outermost(anchors: DataFrame, name: str = "surface", slack: int = 1) -> DataFrame:
    """JN-10: anchors that no other of equal name on the page contains; of equal boxes the smaller id stays."""
    keys = ["doc", "page", name]
    first = anchors.where("x0 <= x1 AND y0 <= y1").groupBy(*keys, *spatial.BOX).agg(F.min("id").alias("_other"))
    # Of boxes of one size the smallest id wins, and a box's copies are there with theirs; so each box is asked for once, for all of its copies.
    inner = first.drop("_other").withColumn("_own", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    around = spatial.containing(inner, first, keys, slack).where("_area >= _own")
    lost = around.groupBy(*keys, *spatial.BOX).agg(F.max(F.col("_area") > F.col("_own")).alias("_larger"), F.min(F.when(F.col("_area") == F.col("_own"), F.col("_other"))).alias("_least"))
    return anchors.join(lost, [*keys, *spatial.BOX], "left").where(~F.coalesce(F.col("_larger") | F.coalesce(F.col("_least") < F.col("id"), F.lit(False)), F.lit(False))).select(*anchors.columns)


def before(df: DataFrame, keys: list[str], order: list[str], value: str, when: Column | None = None, name: str = "before") -> DataFrame:
    """JN-11: as-of join backward: the value of the last earlier row, of those where `when` holds."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(F.col(value) if when is None else F.when(when, F.col(value)), ignorenulls=True).over(w))


def last_definition(uses: DataFrame, definitions: DataFrame, keys: list[str], order: str) -> DataFrame:
    """JN-12, JN-13: for each use (keys, order, src) the last definition (keys, order, dst) before it; a later one hides the earlier. One pass over both sides in order, so a frequent key costs a sort, not a product."""
    d = definitions.select(*keys, F.col(order).alias("_o"), F.lit(1).alias("_side"), F.lit(None).cast(uses.schema["src"].dataType).alias("src"), "dst")
    u = uses.select(*keys, F.col(order).alias("_o"), F.lit(0).alias("_side"), "src", F.lit(None).cast(definitions.schema["dst"].dataType).alias("dst"))
    w = Window.partitionBy(*keys).orderBy("_o", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return d.unionByName(u).withColumn("dst", F.last("dst", ignorenulls=True).over(w)).where("_side = 0 AND dst IS NOT NULL").select(*keys, "src", "dst")


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be broadcast if it has at most `most` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def mentions(texts: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """JN-14: names (key, name, dst) that stand as whole words in texts (key, src, text). Texts are cut into words once; a name meets the texts that hold its first word (one without words meets all of its key), and the pattern decides, once per text and name."""
    first = lambda c: F.regexp_extract(c, r"[\p{L}\p{N}]+", 0)
    parts = F.array_append(F.array_distinct(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))), F.lit(""))
    wanted = small(names.groupBy(key, "name").agg(F.countDistinct("dst").alias("n"), F.min("dst").alias("dst"), F.max("dst").alias("other")).withColumn("part", first(F.col("name"))))
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.col("name"), F.lit(r"\E(?![\p{L}\p{N}])"))
    found = texts.withColumn("part", F.explode(parts)).join(wanted, [key, "part"]).where(F.expr("instr(text, name) > 0")).where(F.regexp_like("text", pattern))
    # A name of one other node is a mention of it; the text's own node does not count.
    one = F.when((F.col("n") == 1) & (F.col("dst") != F.col("src")), F.col("dst")).when((F.col("n") == 2) & (F.col("dst") == F.col("src")), F.col("other")).when((F.col("n") == 2) & (F.col("other") == F.col("src")), F.col("dst"))
    return found.select(key, "src", "name", one.alias("dst")).where("dst IS NOT NULL").distinct()


def unique_names(names: DataFrame, keys: list[str]) -> DataFrame:
    """JN-15: names that stand for one entity."""
    return names.groupBy(*keys).agg(F.countDistinct("entity").alias("_n"), F.min("entity").alias("entity")).where("_n = 1").drop("_n")


def same_statement(nodes: DataFrame) -> DataFrame:
    """JN-16: nodes of one kind with the same non-empty statement, each with the smallest such node. Star pairs, so a statement of n copies gives n - 1 rows and not n squared."""
    groups = nodes.where("length(statement) > 0").groupBy("kind", "statement").agg(F.min("id").alias("first"), F.count("*").alias("_n")).where("_n > 1")
    return nodes.join(groups, ["kind", "statement"]).where("id <> first").select("id", "first", "kind")


def lookup(df: DataFrame, dimension: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """JN-18: columns of a dimension by key, null where it has none."""
    return df.join(dimension.select(key, *columns), key, "left")
