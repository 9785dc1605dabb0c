"""From positioned text runs to nodes, anchors and edges (EXT, ANC, EDG)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import aggregates, relational, tables

# Kinds of numbered environments and what a heading word stands for.
KINDS = ("Definition", "Theorem", "Lemma", "Proposition", "Corollary", "Example", "Notation")
HEADING_KIND = {"definition": "definition", "theorem": "theorem", "lemma": "lemma", "proposition": "proposition", "corollary": "corollary", "example": "example", "notation": "notation", "problem": "example"}
# Words that end an environment when they begin a line.
BREAKS = ("Remark", "Remarks", "Exercise pointer", "Exercises", "References", "Chapter", "Section")
# Words that name no result before "theorem".
GENERIC = ("previous", "preceding", "following", "same", "this", "that", "a", "any", "the", "next", "each", "another", "above", "below", "by", "of", "from")
# Confidences of edges by rule.
LABELLED, ANCHORED, NAMED, OPERATOR, TERM, PREVIOUS, SYMBOL, ABOVE, ASSISTED = 0.95, 0.92, 0.85, 0.9, 0.85, 0.8, 0.8, 0.7, 0.7

# Fixed value: characters of the statement in a node's first clause.
CLAUSE = 500

# What a number, a heading, a reference, a named result and a soft reference look like.
NUMBER = r"(\d+(?:\.\d+)*)"
HEADING = rf"(?i)^({'|'.join(KINDS)}|Problem)\s+{NUMBER}\b(?:\s*\(([^)]+)\))?"
REFERENCE = rf"(?i)\b({'|'.join(KINDS)})\s+{NUMBER}"
RESULT = r"(?i)\b(?:the\s+)?[A-Za-z][A-Za-z–—-]*\s+(?:theorem|lemma|proposition|corollary)\b(?!\s*\d)"
SOFT = (r"(?i)\bthe previous lemma\b", r"(?i)\bas above\b", r"(?i)\bthe spectral theorem\b", r"(?i)\bRank[-–—]?Nullity\b")


def page_lines(spans: DataFrame) -> DataFrame:
    """EXT-01: lines (doc, page, line, y0, text, bold and box) with runs from left to right; bold: any of the first two runs."""
    runs = F.array_sort(F.collect_list(F.struct("x0", "id", "text", "bold")))
    out = spans.groupBy("doc", "page", "line").agg(F.min("y0").alias("y0"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), runs.alias("runs"))
    text = F.concat_ws("", F.transform("runs", lambda r: r["text"]))
    return out.select("doc", "page", "line", "x0", "y0", "x1", "y1", text.alias("text"), F.exists(F.slice("runs", 1, 2), lambda r: r["bold"]).alias("bold"))


def headings(lines: DataFrame) -> DataFrame:
    """EXT-02: lines with kind, label and title where they begin an environment: a proof, or a numbered heading that a full stop follows or that is bold."""
    text = F.trim("text")
    part = lambda i: F.regexp_extract(text, HEADING, i)
    rest = F.ltrim(F.substring(text, F.length(F.regexp_extract(text, HEADING, 0)) + F.lit(1), F.length(text)))
    numbered = (part(1) != "") & (rest.startswith(".") | F.col("bold"))
    proof = F.regexp_like(text, F.lit(r"(?i)^Proof\b"))
    kinds = F.create_map(*[F.lit(x) for kv in HEADING_KIND.items() for x in kv])
    title = F.trim(part(3))
    return lines.select(
        *lines.columns,
        F.when(proof, "proof").when(numbered, kinds[F.lower(part(1))]).alias("kind"),
        F.when(~proof & numbered, F.concat(F.initcap(part(1)), F.lit(" "), part(2))).alias("label"),
        F.when(~proof & numbered & (title != ""), title).alias("title"),
    )


def environments(lines: DataFrame) -> DataFrame:
    """EXT-03, EXT-05: nodes (doc, block, kind, label, title, page, statement, box, confidence): from a heading to the next one or to a section word; the box is that of the first page."""
    stop = F.regexp_like("text", F.lit(rf"(?i)^\s*(?:{'|'.join(BREAKS)})\b"))
    # One shuffle and one sort by document; the groups below stay where they are.
    inside = aggregates.blocks(headings(lines), "doc", ["page", "y0", "line"], F.col("kind").isNotNull(), stop, {"_first": F.col("page")})
    head = lambda c: F.min(F.when(F.col("kind").isNotNull(), F.col(c))).alias(c)
    at = lambda fn, c: fn(F.when(F.col("page") == F.col("_first"), F.col(c))).alias(c)
    body = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("page", "y0", "line", F.trim("text").alias("t")))), lambda x: F.when(x["t"] != "", x["t"])))
    out = inside.groupBy("doc", "block").agg(head("kind"), head("label"), head("title"), F.min("page").alias("page"), body.alias("statement"), at(F.min, "x0"), at(F.min, "y0"), at(F.max, "x1"), at(F.max, "y1"))
    return out.withColumn("clauses", F.array(F.struct(F.lit("i").alias("id"), F.substring("statement", 1, CLAUSE).alias("text")))).withColumn("confidence", F.lit(0.85))


def enriched(nodes: DataFrame, proposals: DataFrame) -> DataFrame:
    """EXT-04: a model's proposals (doc, block, kind, title, confidence) merged: labelled nodes keep their kind, a title fills an empty one, confidence stays in 0 to 1."""
    p = proposals.select("doc", "block", F.col("kind").alias("_k"), F.col("title").alias("_t"), F.col("confidence").alias("_c"))
    out = nodes.join(p, ["doc", "block"], "left")
    kind = F.when(F.col("label").isNotNull(), F.col("kind")).otherwise(F.coalesce("_k", "kind"))
    return out.withColumn("kind", kind).withColumn("title", F.coalesce("title", "_t")).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_c", "confidence")))).drop("_k", "_t", "_c")


def required(df: DataFrame, what: str) -> DataFrame:
    """EXT-05: raise instead of going on with nothing. The rows are written once and looked at there, so their plan runs once."""
    there = tables.saved(df, "required")
    if there.isEmpty():
        raise ValueError(f"no {what}")
    return there


def matches(lines: DataFrame, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(group))


def anchors(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """ANC-01 to ANC-04: (doc, page, y0, x0, surface, target): explicit references, soft phrases and named results, one per line place and surface; an explicit one targets the last node of its label."""
    explicit = F.transform(matches(lines, REFERENCE), lambda m: F.struct(F.concat(F.initcap(F.regexp_extract(m, REFERENCE, 1)), F.lit(" "), F.regexp_extract(m, REFERENCE, 2)).alias("surface"), F.lit(True).alias("explicit")))
    by = F.transform(matches(lines, rf"(?i)\bBy\s+(?:{'|'.join(KINDS)})\s+{NUMBER}"), lambda m: F.struct(F.concat(F.lit("By "), F.initcap(F.regexp_extract(m, REFERENCE, 1)), F.lit(" "), F.regexp_extract(m, REFERENCE, 2)).alias("surface"), F.lit(True).alias("explicit")))
    loose = lambda p: F.transform(matches(lines, p), lambda m: F.struct(m.alias("surface"), F.lit(False).alias("explicit")))
    word = lambda m: F.lower(F.regexp_extract(m, r"(?i)^(?:the\s+)?([A-Za-z][A-Za-z–—-]*)\s", 1))
    named = F.transform(F.filter(matches(lines, RESULT), lambda m: ~word(m).isin(*GENERIC)), lambda m: F.struct(F.regexp_replace(m, r"\s+", " ").alias("surface"), F.lit(False).alias("explicit")))
    found = lines.select("doc", "page", "y0", "x0", F.explode(F.concat(by, explicit, *[loose(p) for p in SOFT], named)).alias("a")).select("doc", "page", "y0", "x0", "a.surface", "a.explicit")
    key = [F.lower("surface").alias("_s"), F.floor("y0").alias("_y"), F.floor("x0").alias("_x")]
    once = found.groupBy("doc", "page", *key).agg(F.min("surface").alias("surface"), F.max("explicit").alias("explicit"), F.min("y0").alias("y0"), F.min("x0").alias("x0"))
    last = nodes.where("label IS NOT NULL").groupBy("doc", F.lower("label").alias("_label")).agg(F.max_by("block", F.struct("page", "block")).alias("target"))
    out = once.withColumn("_label", F.when(F.col("explicit"), F.lower(F.regexp_replace("surface", r"^By ", "")))).join(last, ["doc", "_label"], "left")
    return out.select("doc", "page", "y0", "x0", "surface", "target")


def refined(anchors_: DataFrame, glyphs: DataFrame) -> DataFrame:
    """ANC-05: an anchor's box becomes the glyph box of its surface inside it (2 points of slack), if there is exactly one."""
    g = glyphs.select("doc", "page", "surface", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    inside = (F.col("_x0") >= F.col("x0") - 2) & (F.col("_y0") >= F.col("y0") - 2) & (F.col("_x1") <= F.col("x1") + 2) & (F.col("_y1") <= F.col("y1") + 2)
    one = anchors_.join(g, ["doc", "page", "surface"]).where(inside).groupBy("id").agg(F.count("*").alias("_n"), F.first(F.struct("_x0", "_y0", "_x1", "_y1")).alias("_b")).where("_n = 1")
    out = anchors_.join(one, "id", "left")
    for c in ("x0", "y0", "x1", "y1"):
        out = out.withColumn(c, F.coalesce(F.col(f"_b._{c}"), F.col(c)))
    return out.drop("_n", "_b")


def label_edges(nodes: DataFrame) -> DataFrame:
    """EDG-01: (doc, src, dst, kind, confidence) of labels in bodies, where the document has the label once. `equivalent to` or `restates` before it makes the edge `restates`. nodes: doc, n, label, body."""
    once = nodes.where("label IS NOT NULL").groupBy("doc", F.lower("label").alias("_l")).agg(F.count("*").alias("_c"), F.min("n").alias("dst")).where("_c = 1")
    found = nodes.select("doc", F.col("n").alias("src"), F.explode(F.regexp_extract_all("body", F.lit(rf"(?i)((?:equivalent\s+to|restates?)\s+)?\b(?:{'|'.join(KINDS)})\s+\d+(?:\.\d+)*"), F.lit(0))).alias("m"))
    named = found.withColumn("_l", F.lower(F.concat_ws(" ", F.regexp_extract("m", REFERENCE, 1), F.regexp_extract("m", REFERENCE, 2)))).withColumn("kind", F.when(F.regexp_like("m", F.lit(r"(?i)^(?:equivalent\s+to|restates?)\s")), "restates").otherwise("depends_on"))
    return named.join(once, ["doc", "_l"]).where("src <> dst").select("doc", "src", "dst", "kind", F.lit(LABELLED).alias("confidence")).distinct()


def previous_edges(nodes: DataFrame) -> DataFrame:
    """EDG-03: `previous lemma` depends on the last lemma before, `as above` on it or else on the node before. nodes: doc, n, kind, body."""
    seen = relational.before(nodes, ["doc"], ["n"], "n", F.col("kind") == "lemma", "lemma")
    seen = relational.before(seen, ["doc"], ["n"], "n", None, "any")
    lemma, above = F.lower("body").contains("previous lemma"), F.lower("body").contains("as above")
    dst = F.when(lemma, F.col("lemma")).when(above, F.coalesce("lemma", "any"))
    return seen.select("doc", F.col("n").alias("src"), dst.alias("dst"), F.lit("depends_on").alias("kind"), F.when(lemma, PREVIOUS).otherwise(ABOVE).alias("confidence")).where("dst IS NOT NULL")


# Commands that name an operator in a formula, and words by which a notation is introduced.
BRACED, BARE = r"\\(?:operatorname|mathcal|mathrm)\{[^}]+\}", r"\\(?:ker|coker|Hom|End|Spec)\b"
WRITTEN = r"(?i)\b(?:write|denote)\b"
#: A term begins with a letter and has at most this many characters.
TERM_SIZE = 46


def defined_operators(kind: Column, body: Column) -> Column:
    """EDG-05: operators on the left of an equation in the formulas of a definition or notation."""
    formulas = F.regexp_extract_all(body, F.lit(r"\$([^$]+)\$"), F.lit(1))
    left = F.transform(F.filter(formulas, lambda f: f.contains("=")), lambda f: F.substring_index(f, "=", 1))
    none = F.array().cast("array<string>")
    written = F.when((kind == "notation") & F.regexp_like(body, F.lit(WRITTEN)), F.slice(formulas, 1, 1)).otherwise(none)
    names = F.regexp_extract_all(F.concat_ws(" ", F.concat(left, written)), F.lit(f"{BRACED}|{BARE}"), F.lit(0))
    return F.when(kind.isin("definition", "notation"), F.array_distinct(names)).otherwise(none)


def defined_term(kind: Column, body: Column) -> Column:
    """EDG-05: the term that a definition introduces before its first formula: what stands between its article and the formula, without a last "of", if these are only letters, blanks and hyphens."""
    article = F.regexp_replace(body, r"^[.\s]+", "")
    ahead = F.lower(F.substring_index(article, "$", 1))
    named = F.regexp_extract(ahead, r"^(?:an?|the)\s+(.*\S)\s+$", 1)
    term = F.regexp_replace(named, r"\s+of$", "")
    fits = F.regexp_like(term, F.lit(r"^[a-z][a-z -]+$")) & (F.length(term) <= TERM_SIZE)
    return F.when((kind == "definition") & F.contains(body, F.lit("$")) & fits, term)


def operator_edges(nodes: DataFrame) -> DataFrame:
    """EDG-05, JN-12: uses of defined operators and terms with the last definition before. nodes: doc, n, kind, body. Names are compared within a document only.

    Bodies are cut into commands and words once; a name meets the bodies that hold its first part, and the pattern
    decides. Each use then takes its definition in one ordered pass, so a name that is defined often costs no product.
    """
    names = F.concat(F.transform(defined_operators(F.col("kind"), F.col("body")), lambda o: F.struct(o.alias("name"), F.lit(OPERATOR).alias("c"))), F.filter(F.array(F.struct(defined_term(F.col("kind"), F.col("body")).alias("name"), F.lit(TERM).alias("c"))), lambda x: x["name"].isNotNull()))
    first = F.when(F.col("c") == OPERATOR, F.col("name")).otherwise(F.regexp_extract("name", "^[a-z]+", 0))
    defined = nodes.select("doc", F.col("n").alias("dst"), F.explode(names).alias("d")).select("doc", "dst", "d.name", "d.c")
    wanted = defined.select("doc", "name", "c", first.alias("part")).distinct()
    words = F.regexp_extract_all(F.lower("body"), F.lit("[a-z]+"), F.lit(0))
    commands = lambda p: F.regexp_extract_all("body", F.lit(f"(?=({p}))"), F.lit(1))
    parts = F.array_distinct(F.concat(commands(BRACED), commands(r"\\[A-Za-z]+(?![A-Za-z])"), words, F.transform(words, lambda x: F.regexp_replace(x, "s$", ""))))
    pattern = F.when(F.col("c") == OPERATOR, F.concat(F.lit("\\Q"), F.col("name"), F.when(F.col("name").endswith("}"), F.lit("\\E")).otherwise(F.lit("\\E(?![A-Za-z])")))).otherwise(F.concat(F.lit(r"(?i)(?<![\w-])\Q"), F.col("name"), F.lit(r"\Es?(?![\w-])")))
    # Words move with the bodies' ids only; the few pairs then fetch their body.
    met = nodes.select("doc", "n", F.explode(parts).alias("part")).join(wanted, ["doc", "part"]).select("doc", "n", "name", "c").distinct()
    held = met.join(nodes.select("doc", "n", "kind", "body"), ["doc", "n"]).where(F.regexp_like("body", pattern))
    uses = held.select("doc", "name", F.struct("n", "kind", "c").alias("src"), F.col("n").alias("at"))
    last = relational.last_definition(uses, defined.select("doc", "name", "dst", F.col("dst").alias("at")), ["doc", "name"], "at")
    kind = F.when(F.col("src.kind").isin("definition", "notation"), "uses_notation").otherwise("depends_on")
    return last.groupBy("doc", F.col("src.n").alias("src"), "dst", kind.alias("kind")).agg(F.max("src.c").alias("confidence"))


class Order:
    """A topological order of a growing graph. An edge that goes against the order moves only the nodes between its ends; one that closes a cycle is refused."""

    def __init__(self):
        self.place, self.after, self.before = {}, {}, {}

    def _closure(self, start, links, inside) -> set | None:
        known, stack = {start}, [start]
        while stack:
            for x in links.get(stack.pop(), ()):
                if x not in known and inside(self.place[x]):
                    known.add(x)
                    stack.append(x)
        return known

    def add(self, src, dst) -> bool:
        for x in (src, dst):
            self.place.setdefault(x, len(self.place))
        low, high = self.place[dst], self.place[src]
        if low < high:
            later = self._closure(dst, self.after, lambda p: p <= high)
            if src in later:
                return False
            earlier = self._closure(src, self.before, lambda p: p >= low)
            moved = sorted(earlier, key=self.place.get) + sorted(later, key=self.place.get)
            for x, p in zip(moved, sorted(self.place[x] for x in moved), strict=True):
                self.place[x] = p
        elif src == dst:
            return False
        self.after.setdefault(src, set()).add(dst)
        self.before.setdefault(dst, set()).add(src)
        return True


class Admission:
    """Of one document's edges (src, dst, kind, lone), called in order: whether each is kept. No repeats, no self loops, and, but for `restates`, none that closes a cycle among those kept. A lone one goes where its pair has an edge already."""

    def __init__(self):
        self.order, self.seen, self.pairs = Order(), set(), set()

    def __call__(self, src, dst, kind, lone=False) -> bool:
        new = src != dst and (src, dst, kind) not in self.seen and not (lone and (src, dst) in self.pairs) and (kind == "restates" or self.order.add(src, dst))
        if new:
            self.seen.add((src, dst, kind))
            self.pairs.add((src, dst))
        return new


def admitted(rows) -> list[bool]:
    """Which of one document's edges (src, dst, kind, lone), in order, are kept, by Admission."""
    admit = Admission()
    return [admit(*row) for row in rows]


def acyclic(edges: DataFrame, group: str = "doc") -> DataFrame:
    """EDG-08: edges in order of (phase, place), each kept unless it closes a cycle among those kept; `restates` are exempt, and with a column `lone` those that have it give way to any edge of their pair. What is kept depends on all before it, so a document is read in order by one task, which holds what it kept of one document at a time."""
    order = ["phase", "place", "src", "dst", "kind"]
    rule = ["src", "dst", "kind", *["lone"] * ("lone" in edges.columns)]

    def fold(batches):
        now, admit = None, None
        for batch in batches:
            keep = []
            for key, *row in zip(*(batch.column(c).to_pylist() for c in [group, *rule]), strict=True):
                if (key,) != now:
                    now, admit = (key,), Admission()
                keep.append(admit(*row))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return edges.repartition(group).sortWithinPartitions(group, *map(F.asc_nulls_last, order)).mapInArrow(fold, edges.schema)


def title_pattern(title: Column) -> Column:
    """EDG-04: the pattern of a result's title in a text: its words with white space or dashes between, without a last "theorem", "lemma" or "proposition"; a single word needs one behind it. Null where no word is left."""
    words = F.regexp_extract_all(F.lower(title), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    words = F.when(F.element_at(F.concat(F.array(F.lit("")), words), -1).isin("theorem", "lemma", "proposition"), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    tail = F.when(F.size(words) == 1, r"\s+(?:theorem|lemma|proposition)").otherwise(r"(?:\s+theorem)?")
    return F.when(F.size(words) > 0, F.concat(F.lit(r"(?iU)\b"), F.array_join(words, r"[\s\-–]+"), tail, F.lit(r"\b")))


def title_edges(nodes: DataFrame) -> DataFrame:
    """EDG-04: bodies that name one titled result of their document, other than their own: depends_on, 0.85. Of titles with equal patterns that a body may mean, none is taken. nodes: doc, n, kind, title, body.

    A title meets the bodies that hold its first word by that word and the bodies' ids only; the few pairs then fetch their body, and the pattern decides.
    """
    titled = nodes.where(F.col("kind").isin("theorem", "lemma", "proposition")).select("doc", F.col("n").alias("dst"), title_pattern(F.col("title")).alias("pattern")).where("pattern IS NOT NULL")
    first = F.regexp_extract("pattern", r"^\(\?iU\)\\b([\p{L}\p{N}_]+)", 1)
    words = F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    met = nodes.select("doc", F.col("n").alias("src"), F.explode(words).alias("part")).join(titled.withColumn("part", first), ["doc", "part"]).where("src <> dst").select("doc", "src", "dst", "pattern")
    found = met.join(nodes.select("doc", F.col("n").alias("src"), "body"), ["doc", "src"]).where(F.regexp_like("body", F.col("pattern")))
    one = found.groupBy("doc", "src", "pattern").agg(F.count(F.lit(1)).alias("_k"), F.min("dst").alias("dst")).where("_k = 1")
    return one.select("doc", "src", "dst", F.lit("depends_on").alias("kind"), F.lit(NAMED).alias("confidence"))


def symbol_edges(nodes: DataFrame) -> DataFrame:
    """EDG-06: symbols with the last definition before that has the same symbol in the same role: uses_notation, 0.8. nodes: doc, n, kind, symbols (array of sym, role)."""
    each = nodes.select("doc", "n", "kind", F.posexplode("symbols").alias("place", "s")).select("doc", "n", "kind", "place", "s.sym", "s.role")
    uses = each.select("doc", "sym", "role", F.struct("n", "place").alias("src"), F.col("n").alias("at"))
    defined = each.where("kind = 'definition'").select("doc", "sym", "role", F.col("n").alias("dst"), F.col("n").alias("at")).distinct()
    last = relational.last_definition(uses, defined, ["doc", "sym", "role"], "at")
    return last.groupBy("doc", F.col("src.n").alias("src"), "dst").agg(F.min("src.place").alias("place")).select("doc", "src", "dst", F.lit("uses_notation").alias("kind"), F.lit(SYMBOL).alias("confidence"), "place")


def anchor_edges(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """EDG-02, EDG-03: what a node's anchors say, the node being the smallest around an anchor: depends_on its target, 0.92; on the last lemma for "the previous lemma", 0.8; on it, or else on the node before, for "as above", 0.7. anchors: doc, page, surface, x0 to y1, target, place."""
    known = anchors.withColumn("id", F.struct("doc", "place", "surface", "x0", "y0"))
    owned = relational.owners(known, nodes.select("doc", "page", F.col("n").alias("id"), *relational.spatial.BOX, F.lit("").alias("name")), "edges").select("doc", "id", F.col("owner").alias("src"))
    rows = known.join(owned, ["doc", "id"])
    seen = relational.before(relational.before(nodes.select("doc", "n", "kind"), ["doc"], ["n"], "n", F.col("kind") == "lemma", "lemma"), ["doc"], ["n"], "n", None, "any")
    rows = rows.join(seen.select("doc", F.col("n").alias("src"), "lemma", "any"), ["doc", "src"])
    surface = F.lower("surface")
    dst = F.when(surface.contains("previous lemma"), F.col("lemma")).when(surface.contains("as above"), F.coalesce("lemma", "any"))
    confidence = F.when(surface.contains("previous lemma"), PREVIOUS).otherwise(ABOVE)
    said = rows.where(dst.isNotNull()).select("doc", "src", dst.alias("dst"), confidence.alias("confidence"), F.lit(3).alias("phase"), F.lit(False).alias("lone"), "place")
    target = rows.where("target IS NOT NULL").select("doc", "src", F.col("target").alias("dst"), F.lit(ANCHORED).alias("confidence"), F.lit(2).alias("phase"), F.lit(True).alias("lone"), "place")
    both = target.unionByName(said).where("src <> dst")
    # Of anchors that say the same only the first counts; the others could add nothing.
    once = both.groupBy("doc", "src", "dst", "phase", "lone").agg(F.min(F.struct("place", "confidence")).alias("_f")).select("doc", "src", "dst", "phase", "lone", "_f.*")
    place = F.row_number().over(Window.partitionBy("doc", "phase").orderBy("place", "src", "dst")).cast("long")
    return once.select("doc", "src", "dst", F.lit("depends_on").alias("kind"), "confidence", "phase", "lone", place.alias("place"))


def document_edges(nodes: DataFrame, anchors: DataFrame, keep=lambda df: df) -> DataFrame:
    """EDG-01 to EDG-06 as one set, admitted in order (EDG-08): doc, src, dst, kind, confidence, phase.

    nodes: doc, n (order in the document, and id), kind, label, title, body, page, box, symbols. anchors as of
    mentions.anchor_boxes(), with targets that are n. Labels come first, then targets of anchors (only where their pair has no edge),
    soft references, titles, operators and terms (where the pair has none), and symbols. keep: as of tables.in_place(), by
    which each rule is a job of its own and no task has the sorts of all.
    """
    # Nodes that are held look small, from which a broadcast would be judged; they are merged by document instead.
    nodes, anchors = nodes.hint("merge"), anchors.hint("merge")
    wide = 1 << 20
    by_src = (F.col("src").cast("long") * wide).alias("place")
    phase = lambda df, k, lone, place=by_src: df.select("doc", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "kind", "confidence", F.lit(k).alias("phase"), F.lit(lone).alias("lone"), place)
    said = anchor_edges(nodes, anchors)
    parts = [
        phase(label_edges(nodes), 1, False),
        said.select("doc", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "kind", "confidence", "phase", "lone", "place"),
        phase(title_edges(nodes), 4, False),
        # A body's operators come before its terms.
        phase(operator_edges(nodes), 5, True, (F.col("src").cast("long") * wide + F.when(F.col("confidence") == OPERATOR, 0).otherwise(1)).alias("place")),
        phase(symbol_edges(nodes), 6, False, (F.col("src").cast("long") * wide + F.col("place")).alias("place")),
    ]
    rows = keep(parts[0])
    for p in parts[1:]:
        rows = rows.unionByName(keep(p))
    return acyclic(rows).drop("place", "lone")


def assisted_edges(open_anchors: DataFrame, nodes: DataFrame, propose) -> DataFrame:
    """EDG-07: edges that a function proposes for unclaimed named anchors in batches of six; unknown ids and kinds go. propose: list of (src, surface) to list of (src, dst, kind)."""
    batched = aggregates.batches(open_anchors, ["doc"], ["src", "surface"], 6)
    rows = batched.groupBy("doc", "batch").agg(F.array_sort(F.collect_list(F.struct("src", "surface"))).alias("rows"))
    ask = F.udf(lambda rs: propose([(r["src"], r["surface"]) for r in rs]), "array<struct<src:long,dst:long,kind:string>>", useArrow=True)
    out = rows.select("doc", F.explode(ask("rows")).alias("e")).select("doc", "e.*").where(F.col("kind").isin("depends_on", "uses_notation", "specialises", "restates"))
    known = nodes.select("doc", "n")
    return out.join(known.withColumnRenamed("n", "src"), ["doc", "src"], "left_semi").join(known.withColumnRenamed("n", "dst"), ["doc", "dst"], "left_semi").withColumn("confidence", F.lit(ASSISTED)).where("src <> dst")


def citation_edges(owned: DataFrame, targets: DataFrame) -> DataFrame:
    """EDG-09: owner to target of each resolved citation, with at most 0.95; a target that is a proof gives way to the only statement of its entity. owned: owner, target, confidence; targets: id, kind, entity."""
    t = targets.select(F.col("id").alias("target"), F.col("kind").alias("_k"), F.col("entity").alias("_e"))
    only = targets.where(~F.col("kind").isin("proof", "example") & F.col("entity").isNotNull()).groupBy(F.col("entity").alias("_e")).agg(F.count("*").alias("_n"), F.min("id").alias("_s")).where("_n = 1")
    dst = F.when((F.col("_k") == "proof") & F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("target"))
    out = owned.join(t, "target").join(only, "_e", "left").select(F.col("owner").alias("src"), dst.alias("dst"), F.least(F.lit(0.95), "confidence").alias("confidence")).where("src <> dst")
    return out.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def synced(stored: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """EDG-10, SNK-01: stored edges without old projections that still stand exactly so and are not wanted any more, and with the new ones."""
    keys = ["src", "dst", "kind"]
    gone = old.join(new, keys, "left_anti")
    kept = stored.join(gone, [*keys, "confidence"], "left_anti")
    return kept.unionByName(new.join(kept, keys, "left_anti").select(kept.columns))
