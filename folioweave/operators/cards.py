"""Cards (CRD, VOI): what a reference means where it is made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as S
from . import aggregates, relational, spatial

SYMBOL = r"^(?:\p{L}|\\[A-Za-z]+)$"
# Kinds of nodes that an answer may cite.
STATEMENTS = ("definition", "theorem", "lemma", "proposition", "corollary", "notation")


def contexts(anchors: DataFrame, nodes: DataFrame) -> DataFrame:
    """CRD-01: (id, owner, paragraph, symbols) of anchors whose smallest fitting node has the surface once, in one paragraph, and no symbol of two roles. anchors: id, doc, page, box, surface; nodes: id, doc, page, box, statement, symbols."""
    plain = F.size(F.array_distinct("symbols")) == F.size(F.array_distinct(F.transform("symbols", lambda s: s["sym"])))
    n = nodes.where((F.size("symbols") > 0) & plain).select("doc", "page", *spatial.BOX, F.col("id").alias("owner"), "statement", "symbols")
    # Only ids meet by tiles; texts join once the pairs are known.
    pairs = spatial.containing(anchors.where(F.trim("surface") != "").select("id", "doc", "page", *spatial.BOX, "surface"), n.drop("statement", "symbols"), ["doc", "page"])
    fit = pairs.select("id", "doc", "page", "surface", "owner", "_area").join(n.select("doc", "page", "owner", "statement", "symbols"), ["doc", "page", "owner"]).where(S.occurs_once(F.col("statement"), F.col("surface")))
    best = fit.groupBy("id").agg(F.min(F.struct(F.col("_area").alias("a"), F.col("owner").alias("owner"), S.paragraphs_with(F.col("statement"), F.col("surface"))[0].alias("paragraph"), "symbols")).alias("b"))
    return best.select("id", "b.owner", "b.paragraph", "b.symbols")


def contains_symbol(text: Column, symbol: Column) -> Column:
    return F.regexp_like(symbol, F.lit(SYMBOL)) & F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}_\\])"), S.quoted(symbol), F.lit(r"(?![\p{L}\p{N}_])")))


def grounded(rows: DataFrame) -> DataFrame:
    """CRD-02: rows with `valid`: clause ids known and once; every substitution from a symbol of the target that occurs in its statement to a local one that occurs in the paragraph, one to one, capturing none; the rewrite exactly that; a gloss of one plain line.

    Columns: statement, paragraph, clauses (array of ids), symbols, local (arrays of names), clause_ids, subs (array of from, to), rewritten, gloss.
    """
    known = F.forall("clause_ids", lambda c: F.array_contains("clauses", c)) & (F.size(F.array_distinct("clause_ids")) == F.size("clause_ids"))
    source, goal = F.transform("subs", lambda s: s["from"]), F.transform("subs", lambda s: s["to"])
    each = F.forall("subs", lambda s: F.array_contains("symbols", s["from"]) & F.array_contains("local", s["to"]) & contains_symbol(F.col("statement"), s["from"]) & contains_symbol(F.col("paragraph"), s["to"]))
    once = (F.size(F.array_distinct(source)) == F.size(source)) & (F.size(F.array_distinct(goal)) == F.size(goal))
    free = F.forall("subs", lambda s: (s["from"] == s["to"]) | ~F.array_contains("symbols", s["to"]) | F.array_contains(source, s["to"]))
    ok = F.coalesce(known & each & once & free, F.lit(False))
    pairs = F.when(ok, F.map_from_arrays(source, goal))
    out = rows.withColumn("_ok", ok).withColumn("_made", S.substituted(F.col("statement"), pairs))
    return out.withColumn("valid", F.col("_ok") & (F.col("rewritten") == F.col("_made")) & ~F.regexp_like("gloss", F.lit(r"[<>\r\n]"))).drop("_ok", "_made")


def card_mode(context: Column, model: Column, error: Column, valid: Column) -> Column:
    """CRD-03: why a card falls back to the statement as it stands, or null."""
    return F.when(~context, "missing-context").when(~model, "no-model").when(error, "model-error").when(~valid, "invalid-output")


def with_fallback(anchors: DataFrame, cards: DataFrame, nodes: DataFrame) -> DataFrame:
    """CRD-04: each anchor's card, else one from its target node of the same corpus, else nothing. anchors: id, corpus, target; cards: id, headline, body; nodes: target, corpus, headline, body."""
    n = nodes.select("target", "corpus", F.col("headline").alias("_h"), F.col("body").alias("_b"))
    out = anchors.join(cards.withColumn("_own", F.lit(True)), "id", "left").join(n, ["target", "corpus"], "left")
    return out.select("id", F.coalesce("headline", "_h").alias("headline"), F.coalesce("body", "_b").alias("body"), F.coalesce("_own", F.lit(False)).alias("baked")).where("headline IS NOT NULL")


def pending(anchors: DataFrame, assigned: DataFrame, doc) -> DataFrame:
    """CRD-05: other documents with anchors that a newly assigned entity gives a target."""
    new = anchors.where("target IS NULL").join(assigned.select("entity").distinct(), "entity", "left_semi")
    return new.where(F.col("doc") != doc).select("doc").distinct()


def answer(hops: DataFrame, nodes: DataFrame, budget: int = 1000) -> DataFrame:
    """VOI-01: of each request's trace the first three statements, one per identity, within the characters. hops: request, node, depth, place; nodes: node, kind, identity, statement."""
    seen = hops.join(nodes, "node").where(F.col("kind").isin(*STATEMENTS))
    one = aggregates.first_of(seen, ["request", "identity"], ["depth", "place", "node"])
    return aggregates.within_budget(one, "request", ["depth", "place", "node"], "statement", budget)


def upserted(cards: DataFrame, new: DataFrame) -> DataFrame:
    """SNK-05: cards by anchor, with `changed` where the new one differs from the old one in any column, nulls included."""
    columns = [c for c in cards.columns if c != "anchor"]
    a, b = cards.select("anchor", F.struct(*columns).alias("old")), new.select("anchor", F.struct(*columns).alias("new"))
    both = a.join(b, "anchor", "full")
    return both.select("anchor", F.coalesce("new", "old").alias("c"), (F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("old"))).alias("changed")).select("anchor", "c.*", "changed")
