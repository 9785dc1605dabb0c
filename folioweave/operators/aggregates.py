"""Aggregations, windows, limits and set operations of the graph model (AGG, WIN, SRT, LIM, SET)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import tables


def cost_by_stage(ledger: DataFrame, keep: Column | None = None) -> DataFrame:
    """AGG-01: calls, token sum and cost of each stage; keep is a null-safe filter (FLT-04)."""
    rows = ledger if keep is None else ledger.where(keep)
    return rows.groupBy("stage").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def cost_rollup(ledger: DataFrame) -> DataFrame:
    """AGG-02: cost_by_stage with a grand total in the same pass; measured tells whether any call was counted."""
    total = ledger.rollup("stage").agg(F.count("*").alias("calls"), F.round(F.coalesce(F.sum("cost"), F.lit(0.0)), 4).alias("cost"), F.grouping("stage").cast("int").alias("total"))
    return total.select(F.coalesce("stage", F.lit("all")).alias("stage"), "calls", "cost", "total", (F.col("calls") > 0).alias("measured"))


def collapse_edges(edges: DataFrame) -> DataFrame:
    """AGG-03: parallel edges become one of the greatest confidence."""
    return edges.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def committed(reservations: DataFrame) -> DataFrame:
    """AGG-04: what is spent (actual) or may be (maximum), in micro-USD."""
    return reservations.agg(F.coalesce(F.sum(F.coalesce("actual", "maximum")), F.lit(0)).cast("long").alias("committed"))


def opening_balance(ledger: DataFrame) -> DataFrame:
    """AGG-05, NUM-03: past cost in micro-USD, rounded up."""
    return ledger.agg(F.ceil(F.coalesce(F.sum(F.col("cost").cast("decimal(18,6)")), F.lit(0)) * 1000000).cast("long").alias("opening"))


def ordered_rows(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """AGG-06: a key's values in order; the order columns decide, never arrival."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    return df.groupBy(key).agg(F.transform(packed, lambda x: x["_v"]).alias("rows"))


def best_where(df: DataFrame, key: str, condition: Column, value: str) -> DataFrame:
    """AGG-09: greatest value of each key among rows that meet the condition; null where none does."""
    return df.groupBy(key).agg(F.max(F.when(condition, F.col(value))).alias("best"))


def union_box(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-10: the box around all boxes of a key."""
    return boxes.groupBy(*keys).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def joined_text(df: DataFrame, keys: list[str], order: list[str], text: str, by: str) -> DataFrame:
    """AGG-11: texts in order as one."""
    return df.groupBy(*keys).agg(F.concat_ws(by, F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text])).alias("text"))


def parse_quality(spans: DataFrame, key: str, pages: Column, characters_a_page: float = 400.0) -> DataFrame:
    """AGG-12: 0.55 coverage + 0.25 density + 0.20 (1 - share of empty pages), between 0 and 1."""
    seen = F.countDistinct(F.when(F.length(F.trim("line")) > 0, F.col("page")))
    out = spans.groupBy(key).agg(seen.alias("filled"), F.sum(F.length("line")).alias("characters"), pages.alias("pages"))
    coverage = F.col("filled") / F.col("pages")
    density = F.least(F.lit(1.0), F.col("characters") / (F.col("pages") * F.lit(characters_a_page)))
    empty = (F.col("pages") - F.col("filled")) / F.col("pages")
    score = F.lit(0.55) * coverage + F.lit(0.25) * density + F.lit(0.20) * (F.lit(1.0) - empty)
    return out.select(key, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6).alias("quality"))


def unique_identity(df: DataFrame, key: str, identity: Column, order: list[str], value: str) -> DataFrame:
    """AGG-15: keys that stand for one identity, with their first value in order."""
    grouped = df.groupBy(key).agg(F.countDistinct(identity).alias("_n"), F.min(F.struct(*order, F.col(value).alias("_v"))).alias("_f"))
    return grouped.where("_n = 1").select(key, F.col("_f._v").alias(value))


def edge_scores(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-16: precision, recall and F1 of a set of edges against another."""
    a, b = found.select(*keys).distinct().withColumn("_f", F.lit(1)), wanted.select(*keys).distinct().withColumn("_w", F.lit(1))
    n = a.join(b, keys, "full").agg(F.count("_f").alias("found"), F.count("_w").alias("wanted"), F.count(F.col("_f") + F.col("_w")).alias("hits"))
    p, r = F.try_divide("hits", "found"), F.try_divide("hits", "wanted")
    return n.select("found", "wanted", "hits", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def set_report(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """SET-02: rows that are missing or extra."""
    return wanted.exceptAll(found).withColumn("side", F.lit("missing")).unionByName(found.exceptAll(wanted).withColumn("side", F.lit("extra")))


def bag_recall(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-17: share of wanted rows that are found, each counted as often as it stands; counts per key instead of numbered rows, so a hot key is one row."""
    a = found.groupBy(*keys).agg(F.count("*").alias("_a"))
    b = wanted.groupBy(*keys).agg(F.count("*").alias("_b"))
    n = b.join(a, keys, "left").agg(F.sum("_b").alias("wanted"), F.sum(F.least("_b", F.coalesce("_a", F.lit(0)))).alias("hits"))
    return n.select("wanted", "hits", F.round(F.try_divide("hits", "wanted"), 6).alias("recall"))


def counts_by_kind(found: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """AGG-18: rows of each kind on both sides."""
    a, b = found.groupBy(kind).agg(F.count("*").alias("found")), wanted.groupBy(kind).agg(F.count("*").alias("wanted"))
    return a.join(b, kind, "full").select(kind, F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("wanted", F.lit(0)).alias("wanted"))


def at_places(df: DataFrame, key: str, value: str, share: float) -> DataFrame:
    """The value at place floor(share * n) of each key's ascending order (key, at): a distributed selection.

    Counts of equal values are dealt by ranges of (key, value), so a key of many values is many ranges. Sums by range
    tell which range holds a key's place; only that range's values are summed up in order. Nulls do not count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    dealt = tables.saved(counts.repartitionByRange(F.col(key), F.col(value)).withColumn("_range", F.spark_partition_id()), "ranges")
    # One row for each key and range.
    sums = dealt.groupBy(key, "_range").agg(F.sum("_c").alias("_n"))
    upto = sums.withColumn("_upto", F.sum("_n").over(Window.partitionBy(key).orderBy("_range"))).withColumn("_all", F.sum("_n").over(Window.partitionBy(key)))
    place = F.floor(F.col("_all") * share)
    holds = upto.where((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place)).select(F.col(key).alias("_key"), F.col("_range").alias("_held"), (place - F.col("_upto") + F.col("_n")).alias("_left"))
    there = dealt.join(holds, dealt[key].eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_held")))
    summed = there.withColumn("_upto", F.sum("_c").over(Window.partitionBy(key).orderBy(value)))
    return summed.where("_upto > _left").groupBy(key).agg(F.min(value).alias("at"))


def latency(df: DataFrame, key: str, value: str) -> DataFrame:
    """AGG-19: least, greatest, mean and the value at place floor(0.95 n) of the ascending order."""
    whole = df.groupBy(key).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean")).where("least IS NOT NULL")
    p95 = at_places(df, key, value, 0.95).select(F.col(key).alias("_k"), F.col("at").alias("p95"))
    return whole.join(p95, whole[key].eqNullSafe(F.col("_k"))).drop("_k")


def cost_reduction(before: DataFrame, after: DataFrame) -> DataFrame:
    """AGG-20: per stage cost of two runs and the saving in percent; a stage of one run alone is not comparable (DQ-05)."""
    a, b = before.groupBy("stage").agg(F.sum("cost").alias("a")), after.groupBy("stage").agg(F.sum("cost").alias("b"))
    both = a.join(b, "stage", "full")
    ok = F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") > 0)
    return both.select("stage", F.round("a", 4).alias("before"), F.round("b", 4).alias("after"), F.when(ok, F.round((F.col("a") - F.col("b")) / F.col("a") * 100, 4)).alias("saved"), ok.alias("comparable"))


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str = "n") -> DataFrame:
    """WIN-01: place in reading order within a document."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def paragraphs(spans: DataFrame, doc: str = "doc") -> DataFrame:
    """WIN-02: running paragraph numbers. A paragraph breaks at a gap over 0.85 of the larger size, at an indent over 12 with 0.4 of that gap, or at a new block with a gap over 2; each page adds one."""
    w = Window.partitionBy(doc).orderBy("page", "y0", "x0", "id")
    last = lambda c: F.lag(c).over(w)
    gap, limit = F.col("y0") - last("y1"), F.greatest("size", last("size"), F.lit(1.0)) * 0.85
    same = last("page") == F.col("page")
    new = (gap > limit) | ((F.abs(F.col("x0") - last("x0")) > 12) & (gap > limit * 0.4)) | ((last("block") != F.col("block")) & (gap > 2))
    step = F.when(last("page").isNull(), 0).when(~same, 1).when(new, 1).otherwise(0)
    return spans.withColumn("_s", step).withColumn("para", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_s")


def blocks(lines: DataFrame, doc: str, order: list[str], is_start: Column, is_break: Column, also: dict[str, Column] | None = None) -> DataFrame:
    """WIN-03: each line's block, from its start to the next start or break; lines outside of blocks go. One sort: a line is inside if the last start is behind the last break. also: columns whose values at the block's start each of its lines gets."""
    w = Window.partitionBy(doc).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    marked = lines.withColumn("_start", is_start).withColumn("_break", is_break & ~is_start)
    at = F.when(F.col("_start"), F.lit(1)).when(F.col("_break"), F.lit(0))
    out = marked.select(*lines.columns, F.sum(F.col("_start").cast("int")).over(w).alias("block"), last(at).alias("_in"), *[last(F.when(F.col("_start"), c)).alias(name) for name, c in (also or {}).items()])
    return out.where("block > 0 AND _in = 1").drop("_in")


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str = "previous") -> DataFrame:
    """WIN-04: the value of the row before."""
    return df.withColumn(name, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))


def top_children(edges: DataFrame, k: int = 3) -> DataFrame:
    """WIN-05: each source's k edges of the greatest confidence, ties by target."""
    return edges.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("confidence"), "dst"))).where(F.col("rank") <= k)


def batches(df: DataFrame, key: list[str], order: list[str], size: int) -> DataFrame:
    """WIN-06: batch numbers of `size` rows each."""
    return df.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1) / size).cast("int"))


def greedy_batches(df: DataFrame, key: str, order: str, size: str, rows: int = 24, limit: int = 180_000) -> DataFrame:
    """WIN-06: batches that a row joins while both the count and the bytes stay within limits. The reset depends on all rows before, so a key's rows are read in order; what goes on from row to row is a count and a sum, so a key may have any number of rows and a task any number of keys."""
    import pyarrow as pa

    def fold(batches):
        now, batch, n, total = None, 0, 0, 0
        for part in batches:
            out = []
            for k, x in zip(part.column(key).to_pylist(), part.column(size).to_pylist(), strict=True):
                x = x or 0  # a null has no size
                if (k,) != now:
                    now, batch, n, total = (k,), 0, 0, 0
                if n and (n == rows or total + x > limit):
                    batch, n, total = batch + 1, 0, 0
                n, total = n + 1, total + x
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int32())], [*part.schema.names, "batch"])

    return df.repartition(key).sortWithinPartitions(key, F.asc_nulls_last(order)).mapInArrow(fold, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", batch int")


def top(df: DataFrame, order: list[Column | str], k: int) -> DataFrame:
    """SRT-01, SRT-02, LIM-01: the first k rows; the order must end in a key."""
    return df.orderBy(*order).limit(k)


def within_budget(df: DataFrame, key: str, order: list[str], text: str, budget: int, most: int = 3, notice: str = "[too long]") -> DataFrame:
    """LIM-02: of each key's first `most` texts as many as fit the characters; a text longer than the budget is replaced by a notice, the first that doesn't fit ends the list."""
    ranked = numbered(df, [key], order, "_r").where(F.col("_r") <= most)
    shown = F.when(F.length(text) > budget, F.lit(notice)).otherwise(F.col(text))
    total = F.sum(F.length("shown")).over(Window.partitionBy(key).orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("shown", shown).withColumn("used", total).where(F.col("used") <= budget).select(key, F.col("_r").alias("rank"), "shown", "used")


def union_all(*frames: DataFrame) -> DataFrame:
    """SET-01."""
    return reduce(DataFrame.unionByName, frames)


def first_of(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """SET-03: of each key the first row in order."""
    return numbered(df, keys, order, "_r").where("_r = 1").drop("_r")
