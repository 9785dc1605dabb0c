"""Tables written to the folder that driver and executors share.

Iterations cut their lineage here instead of with localCheckpoint: a lost
executor then costs a task, never a result. A lazy result may still read tables
that were written for it; finished() writes it and deletes those, and clear()
deletes all that this process wrote.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one for local masters only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="folioweave-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


@contextmanager
def _removing_shuffles(spark: SparkSession):
    """Shuffle files of a finished write go at once instead of with the driver's garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Staged:
    """A table in the shared folder: df reads it, drop() deletes its files."""

    def __init__(self, spark: SparkSession, path: str, df: DataFrame):
        self.spark, self.path, self.df = spark, path, df

    def drop(self) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if self in there:
            there.remove(self)


#: Tables that are there, the oldest first.
there: list[Staged] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, which clear() deletes with the tables."""
    path = f"{shared_dir(spark)}/folioweave/{label}-{uuid.uuid4().hex}"
    there.append(Staged(spark, path, None))
    return path


def stage(df: DataFrame, label: str, by: list[str] | None = None) -> Staged:
    """Write df as Parquet (by: partition columns) and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/folioweave/{label}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    with _removing_shuffles(spark):
        (out.partitionBy(*by) if by else out).parquet(path)
    there.append(Staged(spark, path, spark.read.schema(df.schema).parquet(path)))
    return there[-1]


def saved(df: DataFrame, label: str = "saved") -> DataFrame:
    """The same rows, read from a table; released() deletes it."""
    table = stage(df, label)
    table.df.saved_as = table
    return table.df


def released(*frames: DataFrame) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in frames:
        if (table := getattr(df, "saved_as", None)) in there:
            table.drop()


def finished(spark: SparkSession, build: Callable[[], DataFrame], label: str, settings: tuple[str, ...] = ()) -> Staged:
    """The written result of build(); the tables that were written on its way are deleted, the session's settings are as before."""
    before, known = {key: spark.conf.get(key, None) for key in settings}, list(there)
    try:
        out = stage(build(), label)
        for table in [t for t in there if t not in known and t is not out]:
            table.drop()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return out


#: Whether a join moves rows that are dealt by some of its keys only.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def in_place(spark: SparkSession, build: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], label: str) -> DataFrame:
    """The written result of build(keep). keep() holds rows as they are dealt; of those dealt by one key, a document say, joins, groups and windows by it and others move none."""
    held = []

    def keep(df: DataFrame) -> DataFrame:
        held.append(df.persist(StorageLevel.DISK_ONLY))
        # Only what is there already is known to be dealt.
        held[-1].count()
        return held[-1]

    def run() -> DataFrame:
        spark.conf.set(ALL_KEYS, "false")
        return build(keep)

    try:
        return finished(spark, run, label, (ALL_KEYS,)).df
    finally:
        # What reads others goes before them, else it would be planned again.
        for df in reversed(held):
            df.unpersist()


def clear() -> None:
    """Delete all tables that this process wrote; results that read them are gone, too."""
    for table in list(there):
        table.drop()
