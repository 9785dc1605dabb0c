"""How the sources of a language differ in their terms, in exact integers.

Each kept term is one row with an array of counts, one for each source of its
language. From such a wide row higher-order functions emit what the term adds to
each pair of sources; the sums are taken on the map side before anything moves.

A term is a stretch of letters and characters beyond ASCII, A-Z made small.
Tasks sum occurrences by (language, source, term) before anything moves, so no
term, source or language is one task, whatever its share. What is known of each language (its sources, their
totals, the number of kept terms) is one small row; it meets the terms in SALT
copies, so a language with most terms is spread.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stage, trimmed, tune

SALT, ONE = 64, 1_000_000_000
#: Terms of groups that a task sums at a time, and rows that it gives at once.
HELD, ROWS = 400_000, 20_000
#: UTF-8 bytes to those of terms: A-Z become small, all else but letters and bytes of other characters a blank.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and d (documents) of all terms. docs: lang, source, text, none of them null. Tasks sum what they read before it moves, at most HELD terms of groups at a time."""
    tune(docs.sparkSession)

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def summed():
            for (lang, source), (n, d) in held.items():
                terms = list(n)
                for k in range(0, len(terms), ROWS):
                    some = terms[k : k + ROWS]
                    same = lambda x, m=len(some): pa.array([x] * m, pa.string())
                    yield pa.record_batch({"lang": same(lang), "source": same(source), "term": pa.array(some, pa.binary()).cast(pa.string()), "n": pa.array([n[t] for t in some], pa.int64()), "d": pa.array([d[t] for t in some], pa.int64())})
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary()).to_pylist(), strict=True):
                terms = text.translate(LETTERS).split()
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                n.update(terms)
                d.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from summed()
        yield from summed()

    parts = docs.mapInArrow(trimmed(run), "lang string, source string, term string, n long, d long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def share(n: Column, total: Column, terms: Column, added: int) -> Column:
    """1 + floor(ONE * (n + added) / (total + added * terms)), exact for counts of any size."""
    up, down = (n + added).cast("decimal(20,0)") * F.lit(ONE).cast("decimal(10,0)"), (total + terms.cast("long") * added).cast("decimal(20,0)")
    return F.call_function("div", up, down) + 1


def source_divergence(docs: DataFrame, least_docs: int = 30, added: int = 5, top: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Differences of smoothed term shares between the sources of a language, and of each source to its language.

    A language keeps the terms that are in least_docs of its documents or more; V is
    their number. A group (a source of a language, or the language) with n
    occurrences of a term and N of all kept ones has the share p = 1 + floor(10**9 *
    (n + added) / (N + added * V)). Rows: lang, source, part, item, value, rank.
    `pair`: for each other source of the language (item) the sum of |p - q| over the
    kept terms. `term`: the top terms of the source that it has and whose p is above
    the language's q, with p - q. Rank from 1 by falling value, then item in UTF-8 order.

    Defined results: null languages, sources and texts are empty strings, and an
    empty language or source is one like any other; groups without terms have count
    0 of all; with no kept term pairs have 0 and there are no term rows; rows that
    repeat count each; texts may have any length; other columns are left out; an
    empty table gives no rows.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    entries = F.collect_list(F.struct("source", "n")).alias("counts")
    wide = term_counts(docs).groupBy("lang", "term").agg(entries, F.sum("d").alias("d"), F.sum("n").alias("n")).where(F.col("d") >= least_docs)
    kept = stage(wide.select("lang", "term", "counts", "n"), "kept-terms").df
    totals = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("groups"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total"))
    langs = stage(groups.join(sizes, "lang", "left").select("lang", "groups", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total")), "languages").df
    salted = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALT)).cast("int")).drop("n").join(salted, ["lang", "salt"])
    there = F.map_from_entries(F.col("counts"))
    dense = met.withColumn("there", there).select("lang", "term", "terms", "total", "groups", F.transform("groups", lambda g: F.coalesce(F.try_element_at("there", g["source"]), F.lit(0))).alias("n"))
    shares = dense.withColumn("p", F.transform("n", lambda n, i: share(n, F.get("groups", i)["total"], F.col("terms"), added)))
    return _pairs(shares, langs).unionByName(_terms(shares, added, top))


def _pairs(shares: DataFrame, langs: DataFrame) -> DataFrame:
    last = F.size("p") - 1
    apart = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: F.struct(i.alias("i"), j.alias("j"), F.abs(F.get("p", i) - F.get("p", j)).alias("f")))))
    sums = shares.where(F.size("p") > 1).select("lang", F.explode(apart).alias("x")).groupBy("lang", "x.i", "x.j").agg(F.sum("x.f").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("i").alias("own"), F.col("j").alias("other")), F.struct(F.col("j").alias("own"), F.col("i").alias("other")))).alias("x"), "value").select("lang", "x.own", "x.other", "value")
    sources = langs.select("lang", F.col("groups.source").alias("names")).select("lang", "names", F.posexplode("names").alias("own", "source"))
    pairs = sources.select("lang", "own", "source", F.posexplode("names").alias("other", "item")).where("own <> other").join(both, ["lang", "own", "other"], "left")
    value = F.coalesce("value", F.lit(0)).cast("long")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", rank)


def _terms(shares: DataFrame, added: int, top: int) -> DataFrame:
    whole = share(F.aggregate("n", F.lit(0).cast("long"), lambda a, n: a + n), F.col("total"), F.col("terms"), added)
    each = F.transform("groups", lambda g, i: F.struct(g["source"].alias("source"), F.get("n", i).alias("n"), (F.get("p", i) - F.col("q")).alias("value")))
    rows = shares.withColumn("q", whole).select("lang", "term", F.explode(F.filter(each, lambda x: (x["n"] > 0) & (x["value"] > 0))).alias("x"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.select("lang", "x.source", F.lit("term").alias("part"), F.col("term").alias("item"), F.col("x.value").alias("value")).withColumn("rank", rank).where(F.col("rank") <= top)
