"""Hybrid retrieval (RET): word overlap, BM25 over several fields, exact cosine neighbours and reciprocal-rank fusion."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import tokens
from . import tables
from .relational import small


def ranked(hits: DataFrame, keys: list[str], limit: int, by: str = "score") -> DataFrame:
    """Each key's best hits, ties by id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by), "id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def overlap(nodes: DataFrame, queries: DataFrame) -> DataFrame:
    """RET-01: (q, id, score), the number of distinct query words in each text that holds any; nodes: id, text; queries: q, text. Few query words are broadcast, so only hits move and a frequent word is no task of its own."""
    words = nodes.select("id", F.explode(tokens(F.col("text"))).alias("w"))
    asked = queries.select("q", F.explode(tokens(F.col("text"))).alias("w"))
    return words.join(small(asked), "w").groupBy("q", "id").agg(F.count("*").alias("score"))


def lexical(nodes: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """RET-01, SRC-06: the best texts of each query by overlap()."""
    return ranked(overlap(nodes, queries), ["q"], limit)


def _words(field: str) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(field), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


#: Query words, and fields of them, that go to all tasks; more are joined.
FEW = 100_000
#: Word matches, and scores, that one product holds at most.
CELLS = 1 << 22


def counted(nodes: DataFrame, fields: list[str], terms: DataFrame | None = None) -> DataFrame:
    """(field, w, id, size, tf): the words of each row of nodes, counted where the row is, so none moves. terms (w): of these words only."""
    known = None
    if terms is not None:
        terms = terms.select("w").distinct()
        found = terms.limit(FEW + 1).collect()
        known = pa.array([r["w"] for r in found], pa.string()) if len(found) <= FEW else None
    names = list(fields)

    def run(batches):
        for batch in batches:
            for i, field in enumerate(names):
                lists = batch.column(i + 1)
                size = lists.value_lengths().to_numpy()
                words = lists.flatten().dictionary_encode()
                code, row = words.indices.to_numpy(), np.repeat(np.arange(len(size)), size)
                if known is not None:
                    keep = pc.is_in(words.dictionary, value_set=known).to_numpy(zero_copy_only=False)[code]
                    code, row = code[keep], row[keep]
                many = max(len(words.dictionary), 1)
                key, tf = np.unique(row * many + code, return_counts=True)
                row, code = key // many, key % many
                yield pa.record_batch([pa.repeat(pa.scalar(field), len(key)), words.dictionary.take(pa.array(code)), batch.column(0).take(pa.array(row)), pa.array(size[row], pa.int32()), pa.array(tf, pa.int64())], ["field", "w", "id", "size", "tf"])

    kind = StructType([StructField("field", StringType()), StructField("w", StringType()), StructField("id", nodes.schema["id"].dataType), StructField("size", IntegerType()), StructField("tf", LongType())])
    rows = nodes.select("id", *[_words(f).alias(f"_{i}") for i, f in enumerate(names)]).mapInArrow(run, kind)
    return rows if terms is None or known is not None else rows.join(terms, "w", "left_semi").select(*kind.names)


def index(nodes: DataFrame, fields: list[str], terms: DataFrame | None = None) -> DataFrame:
    """RET-08, SNK-09: inverted index (field, w, id, size, tf). terms (w): of these words only, which are picked before anything moves."""
    return counted(nodes, fields, terms).groupBy("field", "w", "id", "size").agg(F.sum("tf").alias("tf"))


def saved_index(nodes: DataFrame, fields: list[str], path: str, buckets: int = 64) -> None:
    """RET-08: the index as a table by field and bucket of the word, from which a search reads its words' parts only."""
    bucket = F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int")
    index(nodes, fields).withColumn("bucket", bucket).repartition("field", "bucket").sortWithinPartitions("w").write.mode("overwrite").partitionBy("field", "bucket").parquet(path)


def loaded_index(spark: SparkSession, path: str, terms: DataFrame, buckets: int = 64) -> DataFrame:
    """The postings of some words (w) from a saved index."""
    wanted = small(terms.select("w").distinct().withColumn("bucket", F.pmod(F.xxhash64("w"), F.lit(buckets)).cast("int")))
    return spark.read.parquet(path).join(wanted, ["bucket", "w"], "left_semi").select("field", "w", "id", "size", "tf")


def field_sizes(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """RET-02: field, n (documents), mean (words), in one pass without cutting texts into rows."""
    one = nodes.agg(F.count("*").alias("n"), *[F.sum(F.size(_words(f))).alias(f"_{i}") for i, f in enumerate(fields)])
    return one.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"_{i}") / F.col("n")).alias("mean")) for i, f in enumerate(fields)])).alias("e")).select("e.field", "n", "e.mean")


def bm25(postings: DataFrame, sizes: DataFrame, queries: DataFrame, boosts: dict[str, float], limit: int = 20, k1: float = 1.2, b: float = 0.75, digits: int | None = None) -> DataFrame:
    """RET-02: (q, id, score, rank), the best field's BM25 times its boost; digits: round scores before they are ranked. sizes: as field_sizes() has them. postings: as index() or counted() have them; rows that differ in tf only are added up.

    The postings of the queries' words are dealt by node and written once; they are all that moves. A task scores its
    nodes against all queries and hands on those that may be among the best. More query words than FEW are joined instead.
    """
    asked = tables.saved(queries.select("q", F.explode(tokens(F.col("text"))).alias("w")).distinct(), "asked")
    if asked.limit(FEW // len(boosts) + 1).count() > FEW // len(boosts):
        return _joined(postings, sizes, asked, boosts, limit, k1, b, digits)
    spark, pairs, fields = postings.sparkSession, asked.collect(), sizes.collect()
    words = sorted({r["w"] for r in pairs})
    place = {q: i for i, q in enumerate(dict.fromkeys(r["q"] for r in pairs))}
    code = F.broadcast(spark.createDataFrame(list(enumerate(words)), "code int, w string"))
    at = F.broadcast(spark.createDataFrame([(i, r["field"]) for i, r in enumerate(fields)], "at int, field string"))
    dealt = postings.join(code, "w").join(at, "field").select("id", "at", "code", F.col("size").cast("int").alias("size"), F.col("tf").cast("long").alias("tf")).repartition("id").sortWithinPartitions("id")
    hits = ArrayType(StructType([StructField("at", IntegerType()), StructField("code", IntegerType()), StructField("size", IntegerType()), StructField("tf", LongType())]))
    there = tables.saved(dealt.mapInArrow(_packed(len(words)), StructType([postings.schema["id"], StructField("hits", hits)])), "postings")
    df = np.zeros((len(fields), len(words)))
    for r in there.select(F.explode("hits").alias("h")).groupBy("h.at", "h.code").count().collect():
        df[r["at"], r["code"]] = r["count"]
    n, mean = (np.array([r[c] or 0 for r in fields], float) for c in ("n", "mean"))
    weight = np.array([boosts.get(r["field"], 1.0) for r in fields])[:, None] * np.log(1 + (n[:, None] - df + 0.5) / (df + 0.5))
    own = {w: i for i, w in enumerate(words)}
    both = np.array(sorted((own[r["w"]], place[r["q"]]) for r in pairs), np.int64).reshape(-1, 2)
    start, of = np.searchsorted(both[:, 0], np.arange(len(words) + 1)), both[:, 1]
    scores = _scores(weight, mean, start, of, len(place), limit, k1, b, digits)
    near = there.mapInArrow(scores, StructType([StructField("_q", IntegerType()), StructField("id", there.schema["id"].dataType), StructField("score", DoubleType())]))
    names = spark.createDataFrame([(i, q) for q, i in place.items()], StructType([StructField("_q", IntegerType()), StructField("q", asked.schema["q"].dataType)]))
    return ranked(near, ["_q"], limit).join(F.broadcast(names), "_q").select("q", "id", "score", "rank")


def _packed(words: int):
    """Rows (id, at, code, size, tf) sorted by id: a row (id, hits) for each id; hits that differ in tf only are one."""

    def lists(rows: pa.Table, of: np.ndarray) -> pa.RecordBatch:
        at, code, size, tf = (rows.column(i).to_numpy() for i in range(1, 5))
        key = (of * (int(at.max()) + 1) + at) * words + code
        order = np.lexsort((size, key))
        key, size = key[order], size[order]
        one = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (size[1:] != size[:-1])]))
        of, first = of[order][one], order[one]
        start = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        hit = pa.StructArray.from_arrays([pa.array(at[first]), pa.array(code[first]), pa.array(size[one]), pa.array(np.add.reduceat(tf[order], one))], ["at", "code", "size", "tf"])
        return pa.record_batch([rows.column(0).combine_chunks().take(pa.array(first[start])), pa.ListArray.from_arrays(pa.array(np.append(start, len(one)), pa.int32()), hit)], ["id", "hits"])

    def run(batches):
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
            same = rows.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            of = np.concatenate([[0], np.cumsum(same[1:] != same[:-1])])
            # The last id may go on in the next batch.
            cut = int(np.searchsorted(of, of[-1]))
            if cut:
                yield lists(rows.slice(0, cut), of[:cut])
            held = rows.slice(cut)
        if held is not None:
            yield lists(held, np.zeros(held.num_rows, np.int64))

    return run


def _scores(weight: np.ndarray, mean: np.ndarray, start: np.ndarray, of: np.ndarray, queries: int, limit: int, k1: float, b: float, digits: int | None):
    """Rows (id, hits) to (_q, id, score) of a task's best nodes of each query; equal scores at the end are all kept, so ties go by id. of[start[w] : start[w + 1]]: the queries that hold the word w."""
    fields = len(weight)

    def run(batches):
        # Of each query the best scores so far: what is under the least of them is not among the best.
        best = np.full((queries, limit), -np.inf)
        for batch in batches:
            hits = batch.column(1)
            size, flat = hits.value_lengths().to_numpy(), hits.flatten()
            at, code, long, tf = (flat.field(i).to_numpy() for i in range(4))
            part = weight[at, code] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * long / mean[at]))
            node, times = np.repeat(np.arange(len(size)), size), start[code + 1] - start[code]
            step = max(1, CELLS // max(1, fields * len(of)))
            for first in range(0, len(size), step):
                some = min(step, len(size) - first)
                lo, hi = np.searchsorted(node, [first, first + some])
                many = times[lo:hi]
                hit = np.repeat(np.arange(lo, hi), many)
                q = of[start[code[hit]] + np.arange(len(hit)) - np.repeat(np.cumsum(many) - many, many)]
                cell = ((node[hit] - first) * fields + at[hit]) * queries + q
                score = np.bincount(cell, part[hit], some * fields * queries)
                none = np.ones(len(score), bool)
                none[cell] = False
                score[none] = -np.inf
                score = score.reshape(some, fields, queries).max(1)
                score = score if digits is None else score.round(digits)
                i, j = np.nonzero((score >= best[:, -1]) & (score > -np.inf))
                best = -np.sort(-np.concatenate([best, score.T], 1), 1)[:, :limit]
                keep = score[i, j] >= best[j, -1]
                i, j = i[keep], j[keep]
                yield pa.record_batch([pa.array(j, pa.int32()), batch.column(0).take(pa.array(first + i)), pa.array(score[i, j])], ["_q", "id", "score"])

    return run


def _joined(postings: DataFrame, sizes: DataFrame, asked: DataFrame, boosts: dict[str, float], limit: int, k1: float, b: float, digits: int | None) -> DataFrame:
    """bm25() for queries (q, w) of any number of words."""
    # The postings of the queries' words, written once: the corpus is cut into words once, for frequencies and scores alike.
    own = postings.join(asked.select("w").distinct(), "w", "left_semi").groupBy("field", "w", "id", "size").agg(F.sum("tf").alias("tf"))
    there = tables.saved(own, "postings")
    df = there.groupBy("field", "w").agg(F.count("*").alias("df"))
    weight = reduce(lambda x, f: x.when(F.col("field") == f, boosts[f]), list(boosts)[1:], F.when(F.col("field") == next(iter(boosts)), boosts[next(iter(boosts))])).otherwise(1.0)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = weight * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("mean")))
    scored = there.join(df, ["field", "w"]).join(F.broadcast(sizes), "field").join(asked, "w")
    fields = scored.groupBy("q", "id", "field").agg(F.sum(part).alias("s"))
    best = F.max("s") if digits is None else F.round(F.max("s"), digits)
    return ranked(fields.groupBy("q", "id").agg(best.alias("score")), ["q"], limit)


#: Queries, and vectors, that one product of matrices holds.
BLOCK = 4096


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 8, scope: str | None = None, digits: int | None = None) -> DataFrame:
    """RET-03, JN-17, RES-01: exact cosine neighbours (q, id, score, rank) of each query (q, v) among vectors (id, v), its own id left out; scope: a column that both must share; digits: round scores before they are ranked.

    Queries and vectors of a scope are dealt into blocks of about BLOCK rows. Each block of queries meets each block of
    vectors in one task, as a product of matrices, which hands on the k best of each query. The work is that of an exact
    search; where that can't be paid for, inverted_file.nearest_listed() looks into a few lists a query.
    """
    on = scope or "_all"
    a = queries.select("q", F.col("v").cast("array<double>").alias("v"), *([F.col(scope)] if scope else [F.lit(1).alias("_all")]))
    b = vectors.select("id", F.col("v").cast("array<double>").alias("v"), *([F.col(scope)] if scope else [F.lit(1).alias("_all")]))
    parts = lambda df, name: df.groupBy(on).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    blocks = small(parts(a, "_qs").join(parts(b, "_vs"), on))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = a.join(blocks, on).withColumn("_x", own("q", "_qs")).withColumn("_y", every("_vs")).select(F.col(on).alias("_a"), F.col("_x").alias("_ax"), F.col("_y").alias("_ay"), "q", "v")
    b = b.join(blocks, on).withColumn("_y", own("id", "_vs")).withColumn("_x", every("_qs")).select(F.col(on).alias("_b"), F.col("_x").alias("_bx"), F.col("_y").alias("_by"), "id", F.col("v").alias("v"))
    kinds = dict(a.dtypes) | dict(b.dtypes)

    def unit(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and unit vectors of the rows that have a direction."""
        ids, rows = np.array(table.column(name).to_pylist(), object), table.column("v").to_pylist()
        fit = [v is not None and None not in v for v in rows]
        x = np.array([v for v, ok in zip(rows, fit, strict=True) if ok], float)
        x, ids = x.reshape(len(x), -1), ids[np.array(fit, bool)]
        norm = np.sqrt((x * x).sum(1))
        return ids[norm > 0], x[norm > 0] / norm[norm > 0, None]

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        (q, x), (i, y) = unit(left, "q"), unit(right, "id")
        for at in range(0, len(q), 512) if len(i) else ():
            score = x[at : at + 512] @ y.T
            score = score if digits is None else score.round(digits)
            for row, one in enumerate(q[at : at + 512]):
                # One more than asked for, beside the query itself; equal scores at the end are all kept, so ties go by id.
                need = min(k + 1, len(i))
                least = np.partition(score[row], len(i) - need)[len(i) - need]
                keep = np.flatnonzero(score[row] >= least)
                keep = keep[i[keep] != one]
                keep = keep[np.lexsort((i[keep], -score[row, keep]))][:k]
                out[0].extend([one] * len(keep))
                out[1].extend(i[keep])
                out[2].extend(score[row, keep].tolist())
        return pa.table([pa.array(out[0], left.schema.field("q").type), pa.array(out[1], right.schema.field("id").type), pa.array(out[2], pa.float64())], ["q", "id", "score"])

    near = a.groupBy("_a", "_ax", "_ay").cogroup(b.groupBy("_b", "_bx", "_by")).applyInArrow(product, f"q {kinds['q']}, id {kinds['id']}, score double")
    return ranked(near, ["q"], k)


def fused(rankings: list[DataFrame], limit: int = 20, k: int = 60) -> DataFrame:
    """RET-04: reciprocal-rank fusion of rankings (q, id, rank); a repeated id counts at its best rank."""
    each = [r.groupBy("q", "id").agg(F.min("rank").alias("rank")) for r in rankings]
    hits = reduce(DataFrame.unionByName, each).groupBy("q", "id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))
    return ranked(hits, ["q"], limit)


def wants_expansion(query: Column, hits: Column) -> Column:
    """RET-05: short queries without lexical hits: at most 80 characters and 5 words."""
    return (hits == 0) & (F.length(query) <= 80) & (F.size(F.split(F.trim(query), r"\s+")) <= 5)


def checked_scope(hits: DataFrame, allowed: DataFrame) -> DataFrame:
    """RET-06: hits of allowed corpora; raises at the first other one."""
    marked = hits.join(allowed.select("corpus").distinct().withColumn("_ok", F.lit(True)), "corpus", "left")
    return marked.where(F.when(F.col("_ok"), True).otherwise(F.raise_error(F.lit("hit outside of the scope")).cast("boolean"))).drop("_ok")


def fan_out(hits: DataFrame, limit: int, merge: bool = False) -> DataFrame:
    """RET-07: each corpus's best hits one after the other, neither ranked nor limited again; merge: the best of all."""
    if merge:
        return ranked(hits, ["q"], limit)
    return ranked(hits, ["q", "corpus"], limit)
