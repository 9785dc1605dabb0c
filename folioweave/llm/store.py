"""Tables in the folder that driver and executors share, under bounds on what one Arrow batch holds."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tables
from ..operators.tables import Staged, clear, shared_dir  # noqa: F401

BOUNDS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def tune(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, whatever the length of the texts; finished() puts the session's own bounds back."""
    for key, value in BOUNDS.items():
        spark.conf.set(key, value)


def stage(df: DataFrame, label: str, by: list[str] | None = None) -> Staged:
    """Write df as Parquet (by: partition columns) and read it back."""
    tune(df.sparkSession)
    return tables.stage(df, label, by)


def finished(spark: SparkSession, build: Callable[[], DataFrame], label: str) -> Staged:
    """The written result of build(); the tables that were staged on its way are deleted, the session's settings are as before."""
    return tables.finished(spark, build, label, tuple(BOUNDS))


#: Bits of one bitmap of Spark's bitmap functions, and how many bitmaps (4 KiB each) one broadcast has at most.
BITS, BITMAPS = 32768, 8192


def numbered(df: DataFrame) -> DataFrame:
    """The rows as struct `doc`, each with a number of its own in `row`; written, so that the numbers stay. Numbers count within the partitions that wrote them, so a file holds a range."""
    return stage(df.select(F.struct(*df.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "rows").df


def picked(rows: DataFrame, marked: DataFrame, keep: bool) -> DataFrame:
    """Of numbered() rows those whose number `marked` has (keep), or has not. No row moves, at any size.

    Marked numbers become bitmaps, one for each BITS rows, which is one bit a row.
    Bitmaps go to the tasks that hold the rows, those of at most BITMAPS blocks of
    rows at a time; each such range of numbers is a scan of its own files, and
    beyond one range the picked rows are written range by range, so that one
    broadcast (32 MiB) is held at a time.
    """
    marks = marked.groupBy(F.bitmap_bucket_number("row").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("_bits"))
    # From the files' own statistics in the main: the last number of each writing partition.
    part = F.shiftright("row", 33)
    last = rows.groupBy(part.alias("part")).agg(F.max("row").alias("last")).agg(F.max("part").alias("parts"), F.max(F.col("last") % F.lit(1 << 33)).alias("most")).first()
    if last["parts"] is None:
        return rows.select("doc.*")
    step = max(1, BITMAPS // (last["most"] // BITS + 2))
    place = F.bitmap_bit_position("row")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    keyed = lambda some, bits: some.withColumn("_block", F.bitmap_bucket_number("row")).join(F.broadcast(bits), "_block", "left").where(hit if keep else ~hit).select("doc.*")
    if last["parts"] < step:
        return keyed(rows, marks)
    marks, out = stage(marks, "bitmaps").df, []
    for first in range(0, last["parts"] + 1, step):
        low, high = first << 33, (first + step) << 33
        some, bits = rows.where((F.col("row") >= low) & (F.col("row") < high)), marks.where((F.col("_block") >= low // BITS) & (F.col("_block") <= high // BITS))
        out.append(stage(keyed(some, bits), f"picked-{first}").df)
    return reduce(DataFrame.unionByName, out)


def trimmed(run):
    """run for mapInArrow; behind it the worker gives freed memory back, so that idle workers don't hold the most that any of their tasks took."""

    def whole(batches):
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return whole


def worker_cache() -> dict:
    """What one Python worker keeps from task to task; each user bounds its own part."""
    import sys
    import types

    return vars(sys.modules.setdefault("_folioweave_worker", types.ModuleType("_folioweave_worker")))
