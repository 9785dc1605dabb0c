"""Documents whose sets of word shingles have a Jaccard similarity of at least a threshold, and their components.

Documents of equal sets are one class, for which its smallest id stands. How
many documents hold a shingle is counted over the corpus (exchange.census) and
orders the shingles, rarest first. Two sets of the wanted similarity share a
shingle among the first n - ceil(t * n) + 1 of each; shingles of one document
alone can't be that one, so a document with enough of them has no entry at all.
Pairs that meet at a shingle pass the length and positional filters, suffix
filters (parity bits of both sets, then parts of the sets), and one exact
verification.

All pairs of a group are never made. A group's documents are first held
against its most central member (fewest shingles of its own), which joins
nearly all of a group of near copies; after two such rounds only pairs between
different components of a group remain, and all of these are verified. So every
link counts for the components, though links inside a component need not be
listed. In that last round only documents outside of the component of a group's
leader look for partners, by levels of set size (sets that may link stand in one
level or in neighbouring ones); a level of more than BLOCK documents meets in
pairs of blocks, each a task's worth, and the filters stand in the join, so only
pairs that pass them are made. A pair that was verified once, linked or not, is
not verified again.

Defined results: words are runs without white space, A-Z lower-cased; fewer
words than a shingle are one shingle; texts without words, and null ones, have
size 0 and link with nothing; a null id is in no component; rows that repeat an
id are linked through any of their texts; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.resolve import stars
from . import exchange as ex
from .store import stage, trimmed, tune
from .words import Hasher, Words, grams, mix, secret

U = np.uint64
SEED = 0x7A77
FIRST = "kind int, bucket int, grp int, payload binary, doc_id long, n long, k1 long, k2 long"
SECOND = "doc_id long, key long, n long, alone double, shared binary, h array<long>, pos array<int>, bits array<long>"
#: Parity bits of a set. Two sets differ in at least as many shingles as their parities differ in bits.
BITS = 1024
#: Documents of one shingle and level that meet those of another block in one task.
BLOCK = 2048


def shingle_sets(table: pa.Table, n: int, key: int = 0) -> list[np.ndarray]:
    """The distinct shingle hashes of each document, ascending."""
    w = Words(table["text"], Hasher(True, key=key))
    all_, first, out = grams(w.hash, n, SEED), w.first.tolist(), []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= n:
            s = np.sort(all_[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            out.append(grams(w.hash[a:b], b - a, SEED + 2 * (b - a)) if b > a else np.zeros(0, U))
    return out


def most_shared(a: np.ndarray, b: np.ndarray, depth: int = 3) -> int:
    """Suffix filter: what two ascending sets share at most, by splitting both at the middle of the larger one."""
    if depth == 0 or not len(a) or not len(b):
        return min(len(a), len(b))
    middle = (a if len(a) >= len(b) else b)[max(len(a), len(b)) // 2]
    i, j = np.searchsorted(a, middle), np.searchsorted(b, middle)
    return most_shared(a[:i], b[:j], depth - 1) + most_shared(a[i:], b[j:], depth - 1)


def parity(s: np.ndarray) -> np.ndarray:
    odd = np.bincount((s % U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def set_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The size of each set and, in two rows, sums that tell sets apart."""
    size = np.array([len(s) for s in sets], np.int64)
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(size)])
    total = np.concatenate([np.zeros((2, 1), U), np.cumsum(np.stack([mix(flat + U(1)), mix(flat ^ U(0x5DEECE66D))]), axis=1)], axis=1)
    return size, (total[:, at[1:]] - total[:, at[:-1]]).view(np.int64)


def linked(a: np.ndarray, na: int, b: np.ndarray, nb: int, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union; a and b hold all that the sets of sizes na and nb can share."""
    need = -(-percent * (na + nb) // (100 + percent))
    if min(len(a), len(b)) < need or most_shared(a, b) < need:
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    return int(ex.found(small, large)[0].sum()) >= need


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id that links lead to, its own included) of each row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    tune(spark)
    groups, buckets = ex.counts_for(ex.text_bytes(docs, "text"))
    names, key = [f.split()[0] for f in FIRST.split(", ")], secret()

    def count(grp, replies, table):
        sets = shingle_sets(table, n, key)
        held = np.concatenate([k[np.concatenate([[True], k[1:] != k[:-1]])] for s in sets if len(s) for k in [ex.prefixed(s, buckets)]] or [np.zeros(0, U)])
        keys, times = np.unique(held, return_counts=True)
        rows = list(ex.census_blocks(grp, keys, times, buckets))
        for i in range(0, len(rows), 32):
            b, _, payload = zip(*rows[i : i + 32], strict=True)
            m = len(b)
            none = pa.nulls(m, pa.int64())
            yield pa.record_batch([pa.array([0] * m, pa.int32()), pa.array(b, pa.int32()), pa.array([int(grp)] * m, pa.int32()), pa.array(payload, pa.binary()), none, none, none, none], names)
        size, sums = set_keys(sets)
        m = len(size)
        yield pa.record_batch([pa.array([1] * m, pa.int32()), pa.nulls(m, pa.int32()), pa.array([int(grp)] * m, pa.int32()), pa.nulls(m, pa.binary()), table["doc_id"].combine_chunks(), pa.array(size), pa.array(sums[0]), pa.array(sums[1])], names)

    first = stage(ex.in_groups(docs, {}, groups).mapInArrow(ex.by_group(count), FIRST), "shingles", ["kind"])
    df_reply = stage(ex.in_buckets(first.df.where("kind = 0"), buckets).mapInArrow(ex.by_bucket(ex.census), ex.REPLY), "shingle-counts")
    sized = first.df.where("kind = 1").select("grp", "doc_id", "n", "k1", "k2")
    # A table of its own, so that the rows of a large class can be split in the join.
    classes = stage(sized.where("doc_id IS NOT NULL AND n > 0").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")), "classes").df
    member = stage(sized.where("doc_id IS NOT NULL AND n > 0").join(classes, ["n", "k1", "k2"]).select("grp", "doc_id", "n", "k1", "k2", "rep"), "members")
    copies = member.df.where("doc_id <> rep").groupBy("grp").agg(F.to_json(F.collect_set(F.array("doc_id", "n", "k1", "k2"))).cast("binary").alias("payload")).withColumn("bucket", F.lit(0))

    def entries(grp, replies, table):
        import json

        keys, counts = ex.shared_keys(replies.get(1))
        drop = {tuple(x) for x in json.loads(replies[2][0])} if 2 in replies else set()
        # An id that stands once needs no look at its set; of one that repeats only the rows of a copied text leave.
        copied, ids = {x[0] for x in drop}, table["doc_id"].to_pylist()
        times = Counter(ids)
        table = table.filter(pa.array([i is not None and (i not in copied or times[i] > 1) for i in ids], pa.bool_()))
        rows, held, seen = [], 0, set()
        sets = shingle_sets(table, n, key) if table.num_rows else []
        size, sums = set_keys(sets) if sets else (np.zeros(0, np.int64), np.zeros((2, 0), np.int64))
        for doc, s, m, k1, k2 in zip(table["doc_id"].to_pylist(), sets, size.tolist(), *sums.tolist(), strict=True):
            if (doc, m, k1, k2) in drop or (doc, m, k1, k2) in seen:
                continue
            seen.add((doc, m, k1, k2))
            hit, at = ex.found(ex.prefixed(s, buckets), keys)
            alone, first_ = len(s) - int(hit.sum()), len(s) - -(-percent * len(s) // 100) + 1
            if alone >= first_ or not len(s):
                continue
            shared = s[hit]
            order = np.lexsort((shared, counts[at[hit]]))[: first_ - alone]
            rows.append((doc, k1, len(s), alone / len(s), ex.pack(shared), shared[order].view(np.int64), np.arange(alone, first_, dtype=np.int32), parity(s)))
            held += len(rows[-1][4])
            if held > 4 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    found = stage(ex.in_groups(docs, {1: df_reply.df, 2: copies}, groups).mapInArrow(ex.by_group(entries), SECOND), "prefixes")
    df_reply.drop()
    sets = found.df.select("doc_id", "n", "shared")
    exploded = found.df.select("doc_id", "key", "n", "alone", F.explode(F.arrays_zip("h", "pos")).alias("e")).select(F.col("e.h").alias("h"), F.col("e.pos").alias("pos"), "doc_id", "key", "n", "alone")
    # Of shingles that the same documents hold one is enough: two 64-bit sums over the documents, and their texts if ids repeat, tell.
    held = exploded.groupBy("h").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("doc_id", "key")).alias("x"), F.bit_xor(F.xxhash64("doc_id", "key", F.lit(1))).alias("y"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    one = held.where("least <> most").groupBy("c", "x", "y", "least").agg(F.min("h").alias("h")).select("h")
    met = stage(exploded.join(one, "h").drop("key"), "met")
    near_enough = F.expr(f"100 * least(n, n2) >= {percent} * greatest(n, n2) AND (100 + {percent}) * (least(pos, pos2) + 1L + least(n - pos, n2 - pos2) - 1L) >= {percent} * (n + n2)")

    tried: list[DataFrame] = []

    def verified(pairs: DataFrame, turn: int) -> DataFrame:
        """The pairs (a, b), each once and none that was tried before, that are linked."""
        fresh = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        for known in tried:
            fresh = fresh.join(known, ["a", "b"], "left_anti")
        fresh = stage(fresh, f"pairs-{turn}").df
        tried.append(fresh)
        a = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))

        def run(batches):
            for batch in batches:
                keep = [linked(ex.unpack(sa), na, ex.unpack(sb), nb, percent) for na, sa, nb, sb in zip(*(batch.column(c).to_pylist() for c in ("na", "sa", "nb", "sb")), strict=True)]
                yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

        joined = fresh.join(b, "b").join(a, "a").select("a", "b", "na", "sa", "nb", "sb")
        return stage(joined.mapInArrow(trimmed(run), "a long, b long"), f"links-{turn}").df

    def star(rows: DataFrame, best, turn: int) -> DataFrame:
        """Pairs of each document with its groups' leaders: the best rows by group. Leaders are a table of their own, so that a frequent shingle's rows can be split in the join."""
        leader = rows.groupBy("h").agg(best.alias("l")).where("l IS NOT NULL").select("h", F.col("l.doc_id").alias("b"), F.col("l.n").alias("n2"), F.col("l.pos").alias("pos2"))
        return rows.join(stage(leader, f"leaders-{turn}").df, "h").where("doc_id <> b").where(near_enough).select(F.col("doc_id").alias("a"), "b")

    central = F.struct("alone", "doc_id", "n", "pos")
    done = [verified(star(met.df, F.min(central), 1), 1)]
    for turn in (2, 3):
        label = stars(done[0] if len(done) == 1 else done[0].unionByName(done[1])).select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
        marked = stage(met.df.join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")), f"marked-{turn}").df
        split = marked.groupBy("h").agg(F.min("component").alias("least"), F.max("component").alias("most"), F.min(F.struct("alone", "doc_id", "component")).alias("l")).where("least <> most").select("h", F.col("l.component").alias("of_leader"))
        rest = marked.join(stage(split, f"split-{turn}").df, "h")
        if turn == 2:
            done.append(verified(star(rest, F.min(F.when(F.col("component") != F.col("of_leader"), central)), turn), turn))
            continue
        # The parities tell how many shingles two sets differ in at least, before either set is fetched.
        k = BITS // 64
        bits = found.df.select("doc_id", *[F.col("bits")[i].alias(f"p{i}") for i in range(k)])
        level = F.floor(F.log("n") / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
        rest = stage(rest.withColumn("level", level.cast("long")).join(bits, "doc_id").select("h", "level", "doc_id", "n", "pos", "component", (F.col("component") != F.col("of_leader")).alias("asks"), *[f"p{i}" for i in range(k)]), "apart").df
        asks = rest.where("asks").withColumn("level", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)))
        count = asks.groupBy("h", "level").agg(F.count("*").alias("na")).join(rest.groupBy("h", "level").agg(F.count("*").alias("nb")), ["h", "level"])
        size = stage(count.select("h", "level", F.ceil(F.col("na") / BLOCK).cast("int").alias("xs"), F.ceil(F.col("nb") / BLOCK).cast("int").alias("ys")), "blocks").df
        own = lambda by: F.pmod(F.xxhash64("doc_id", F.lit("block")), by).cast("int")
        every = lambda by: F.explode(F.sequence(F.lit(0), by - 1))
        one = asks.join(size, ["h", "level"]).withColumn("x", own(F.col("xs"))).withColumn("y", every(F.col("ys"))).drop("asks", "xs", "ys")
        two = rest.join(size, ["h", "level"]).withColumn("y", own(F.col("ys"))).withColumn("x", every(F.col("xs")))
        two = two.select("h", "level", "x", "y", F.col("doc_id").alias("b"), F.col("n").alias("n2"), F.col("pos").alias("pos2"), F.col("component").alias("component2"), F.col("asks").alias("asks2"), *[F.col(f"p{i}").alias(f"q{i}") for i in range(k)])
        apart = " + ".join(f"bit_count(p{i} ^ q{i})" for i in range(k))
        close = F.expr(f"(100 + {percent}) * ({apart}) <= (100 - {percent}) * (n + n2)")
        # Of two that ask the smaller id does.
        pairs = one.join(two, ["h", "level", "x", "y"]).where("component <> component2 AND (NOT asks2 OR doc_id < b)").where(near_enough & close).select(F.col("doc_id").alias("a"), "b")
        done.append(verified(pairs, turn))
    links = done[0].unionByName(done[1]).unionByName(done[2])
    own = member.df.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    label = stars(links.unionByName(own)).select(F.col("u").alias("doc_id"), F.col("v").alias("component"))
    out = sized.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc, key, size, alone, shared, h, pos, bits = zip(*rows, strict=True)
    return pa.record_batch([pa.array(doc, pa.int64()), pa.array(key, pa.int64()), pa.array(size, pa.int64()), pa.array(alone, pa.float64()), pa.array(shared, pa.binary()), pa.array(h, pa.list_(pa.int64())), pa.array(pos, pa.list_(pa.int32())), pa.array(bits, pa.list_(pa.int64()))], [f.split()[0] for f in SECOND.split(", ")])
