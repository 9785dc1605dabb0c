"""Reproducible shuffle into shards: a Feistel permutation, with cycle walking, of global row numbers.

Rows are numbered by (doc_id, size, crc32). The permutation works on pairs
(left, right) of a rectangle of a times b cells, a * b >= rows, that has fewer
than a cells too many; a cell beyond the rows is permuted again until it falls
among them. Place p of the permutation is slot p div shards of shard p mod
shards, so both can be computed from a row number alone, and shards differ by
one row at most (law `rows`). Everything is a SQL expression.

Defined results: null texts have no bytes, null ids come first, rows that
repeat are numbered in any order (they are alike), an empty table gives an
empty one, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stage

PRIME = (1 << 31) - 1
ROUNDS, WALK = 6, 64


def _keys(seed: int) -> list[tuple[int, int, int]]:
    digest = [hashlib.sha256(f"{seed}/{i}".encode()).digest() for i in range(ROUNDS)]
    return [tuple(int.from_bytes(d[8 * k : 8 * k + 4], "big") % (PRIME - 1) + 1 for k in range(3)) for d in digest]


def permuted(number: Column, rows: int, seed: int) -> Column:
    """The place of a row number in 0..rows-1; raises where 64 walks don't end, which has a chance of rows**-32."""
    a = math.isqrt(max(rows, 1) - 1) + 1
    b = -(-rows // a) or 1
    keys = F.array(*[F.struct(F.lit(i % 2 == 0).alias("left"), F.lit(m).cast("long").alias("m"), F.lit(k).cast("long").alias("k"), F.lit(c).cast("long").alias("c")) for i, (m, k, c) in enumerate(_keys(seed))])

    def scrambled(v: Column, key: Column) -> Column:
        x = (v * key["m"] + key["k"]) % PRIME
        return (x * x + key["c"]) % PRIME

    def one_round(pair: Column, key: Column) -> Column:
        left, right = pair["l"], pair["r"]
        new_left = F.when(key["left"], (left + scrambled(right, key)) % a).otherwise(left)
        new_right = F.when(key["left"], right).otherwise((right + scrambled(left, key)) % b)
        return F.struct(new_left.alias("l"), new_right.alias("r"))

    def once(x: Column) -> Column:
        pair = F.struct(((x - x % b) / F.lit(b)).cast("long").alias("l"), (x % b).alias("r"))  # exact below 2**53 rows
        return F.aggregate(keys, pair, one_round, lambda p: p["l"] * b + p["r"])

    walked = F.aggregate(F.sequence(F.lit(2), F.lit(WALK)), once(number), lambda x, _: F.when(x < rows, x).otherwise(once(x)))
    return F.when(walked < rows, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def numbered(df: DataFrame, order: list[str], name: str = "row_number") -> tuple[DataFrame, int]:
    """df with global row numbers from 0 by `order`, and the count: range partitions, then each one's offset. No task sees more than its range."""
    spread = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = spread.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    table = stage(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered").df
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    # One row for each partition of the range exchange, so its size is bounded by spark.sql.shuffle.partitions.
    out = table.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before", "_at")
    return out, table.count()


def shard(docs: DataFrame, shards: int = 40, seed: int = 20240601, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and row_number."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")).alias("text_crc32"),
    )
    table, count = numbered(stage(rows, "sizes").df, ["doc_id", "size", "text_crc32"])
    place = table.withColumn("_p", permuted(F.col("row_number"), count, seed))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"), F.floor(F.col("_p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number"
    )
