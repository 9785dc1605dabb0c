"""An inverted index that grows by segments (RET-08, SNK-09, SNK-10).

Adding nodes writes a segment (their postings by bucket of the word, and their
sizes) and tombstones for their ids; removing writes tombstones. Nothing that is
there is read or changed. A tombstone hides its id in all segments older than
itself, so a node that comes again replaces what it was. Which segments and
tombstones count is one version (see versions): readers see whole states, and of
two writers one is refused.

A search reads the queries' words from the buckets that hold them in every
segment, drops hidden postings, and counts frequencies and sizes over what is
left: scores are those of an index built anew. Segments of about one size are
merged when there are MERGE of them, so their number grows with the logarithm of
the nodes; tombstones that have nothing older to hide go with a merge.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import retrieval, tables
from .relational import small
from .versions import Versions

MERGE = 4
#: Words of a segment that one task sorts and writes.
ROWS_A_TASK = 1_000_000
#: Repeated ids that go to all tasks; if there are more, all nodes are grouped by id.
REPEATED = 100_000


def tier(nodes: int) -> int:
    return int(math.log(max(nodes, 1), MERGE))


class Segments:
    """nodes: id and the fields. An id of null has no place in an index and is left out."""

    def __init__(self, spark: SparkSession, path: str, fields: list[str], buckets: int = 64):
        self.spark, self.path, self.fields, self.buckets = spark, path.rstrip("/"), fields, buckets
        self.versions = Versions(spark, f"{self.path}/versions")

    def _state(self) -> tuple[int, dict]:
        number, says = self.versions.latest()
        return number, says or {"segments": [], "tombstones": []}

    def _bucket(self):
        return F.pmod(F.xxhash64("w"), F.lit(self.buckets)).cast("int")

    def _write(self, postings: DataFrame, sizes: DataFrame) -> tuple[str, int]:
        name = uuid.uuid4().hex
        sizes.write.parquet(f"{self.path}/{name}/sizes")
        words = sum((F.coalesce(F.sum(f), F.lit(0)) for f in self.fields), F.lit(0))
        count, total = self.spark.read.parquet(f"{self.path}/{name}/sizes").agg(F.count(F.lit(1)), words).first()
        # Tasks grow in number with the words, and so do the pieces of a bucket. Equal words stand together, in the order of a number, which sorts faster than they do; writing by bucket keeps that order.
        tasks = max(self.spark.sparkContext.defaultParallelism, -(-total // ROWS_A_TASK))
        piece = F.pmod(F.xxhash64("id"), F.lit(-(-tasks // self.buckets)))
        postings.withColumn("bucket", self._bucket()).repartition(tasks, "bucket", piece).sortWithinPartitions(F.xxhash64("w")).write.partitionBy("bucket").parquet(f"{self.path}/{name}/postings")
        return name, count

    def _tombstone(self, ids: DataFrame) -> str:
        name = uuid.uuid4().hex
        ids.select("id").where("id IS NOT NULL").distinct().write.parquet(f"{self.path}/{name}/gone")
        return name

    def add(self, nodes: DataFrame) -> int:
        """Adds nodes, or replaces those whose id is there; of nodes that repeat an id one is taken, the least by its fields. The new version."""
        number, state = self._state()
        one = self._one_each(nodes)
        sizes = one.select("id", *[F.size(retrieval._words(f)).alias(f) for f in self.fields])
        name, count = self._write(retrieval.counted(one, self.fields), sizes)
        state["tombstones"].append({"name": self._tombstone(one), "version": number + 1})
        state["segments"].append({"name": name, "version": number + 1, "nodes": count})
        return self.versions.commit(number, state)

    def _one_each(self, nodes: DataFrame) -> DataFrame:
        """One node for each id, the least by its fields. Only the texts of repeated ids move, to be compared."""
        rows = nodes.where("id IS NOT NULL").select("id", *self.fields)
        least = lambda some: some.groupBy("id").agg(F.min(F.struct(*self.fields)).alias("f")).select("id", "f.*")
        repeated = tables.saved(rows.groupBy("id").count().where("count > 1").select("id"), "repeated")
        many = repeated.limit(REPEATED + 1).count()
        if many > REPEATED:
            return least(rows)
        again = F.broadcast(repeated)
        return rows.join(again, "id", "left_anti").unionByName(least(rows.join(again, "id", "left_semi"))) if many else rows

    def remove(self, ids: DataFrame) -> int:
        number, state = self._state()
        state["tombstones"].append({"name": self._tombstone(ids), "version": number + 1})
        return self.versions.commit(number, state)

    def keep_only(self, ids: DataFrame) -> int:
        """SNK-10: removes what is not among the ids of the authoritative snapshot, of any number."""
        there = self.sizes().select("id")
        return self.remove(there.join(ids.select("id"), "id", "left_anti"))

    def _live(self, kind: str, state: dict, segments: list[dict], pick=None) -> DataFrame:
        parts = [self.spark.read.parquet(f"{self.path}/{s['name']}/{kind}").withColumn("_version", F.lit(s["version"])) for s in segments]
        rows = reduce(DataFrame.unionByName, map(pick, parts) if pick else parts)
        oldest = min(s["version"] for s in segments)
        gone = [self.spark.read.parquet(f"{self.path}/{t['name']}/gone").withColumn("_gone", F.lit(t["version"])) for t in state["tombstones"] if t["version"] > oldest]
        if gone:
            last = reduce(DataFrame.unionByName, gone).groupBy("id").agg(F.max("_gone").alias("_gone"))
            rows = rows.join(last, "id", "left").where("_gone IS NULL OR _gone <= _version").drop("_gone")
        return rows.drop("_version")

    def sizes(self, state: dict | None = None) -> DataFrame | None:
        """id and the words of each field of the nodes that count; None while there is no segment."""
        state = state or self._state()[1]
        return self._live("sizes", state, state["segments"]) if state["segments"] else None

    def search(self, queries: DataFrame, boosts: dict[str, float], limit: int = 20, digits: int | None = None) -> DataFrame:
        """RET-02 as retrieval.bm25(): (q, id, score, rank). RET-06: nothing while there is no segment."""
        state = self._state()[1]
        if not state["segments"]:
            return queries.limit(0).select("q", F.lit(None).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        terms = small(queries.select(F.explode(tokens(F.col("text"))).alias("w")).distinct().withColumn("bucket", self._bucket()))
        postings = self._live("postings", state, state["segments"], lambda p: p.join(terms, ["bucket", "w"], "left_semi")).drop("bucket")
        sums = self.sizes(state).agg(F.count(F.lit(1)).alias("n"), *[F.sum(f).alias(f"_{i}") for i, f in enumerate(self.fields)])
        means = sums.select("n", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f"_{i}") / F.col("n")).alias("mean")) for i, f in enumerate(self.fields)])).alias("e")).select("e.field", "n", "e.mean")
        return retrieval.bm25(postings, means, queries, boosts, limit, digits=digits)

    def compact(self) -> int:
        """Merges each tier that has MERGE segments or more, and again what that makes; the version at the end."""
        while True:
            number, state = self._state()
            tiers: dict[int, list[dict]] = {}
            for s in state["segments"]:
                tiers.setdefault(tier(s["nodes"]), []).append(s)
            merged = next((x for _, x in sorted(tiers.items()) if len(x) >= MERGE), None)
            if not merged:
                return number
            name, count = self._write(self._live("postings", state, merged).drop("bucket"), self._live("sizes", state, merged))
            rest = [s for s in state["segments"] if s not in merged]
            says = {"segments": [*rest, {"name": name, "version": number + 1, "nodes": count}], "tombstones": [t for t in state["tombstones"] if any(s["version"] < t["version"] for s in rest)]}
            self.versions.commit(number, says)
