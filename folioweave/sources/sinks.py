"""Sinks (SNK): how tables take new rows. Tables are Parquet folders; a changed table is written anew and swapped by the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as S


def inserted(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-01: the table and those new rows whose key it lacks; of new rows of one key the first by all columns."""
    one = new.groupBy(*keys).agg(F.min(F.struct(*[c for c in table.columns if c not in keys])).alias("_r")).select(*keys, "_r.*") if len(table.columns) > len(keys) else new.distinct()
    return table.unionByName(one.join(table, keys, "left_anti").select(table.columns))


def upserted(table: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """SNK-02: of each key the row of the greatest version; both sides are pre-aggregated."""
    rest = [c for c in table.columns if c not in keys]
    both = table.withColumn("_new", F.lit(0)).unionByName(new.select(table.columns).withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "_new")).alias("_r")).select(*keys, "_r.*").select(table.columns)


def strengthened(edges: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("src", "dst", "kind")) -> DataFrame:
    """SNK-03: the greatest confidence of each edge; the extractor stays the stored one's."""
    both = edges.withColumn("_new", F.lit(0)).unionByName(new.select(edges.columns).withColumn("_new", F.lit(1)))
    return both.groupBy(*keys).agg(F.min_by("extractor", "_new").alias("extractor"), F.max("confidence").alias("confidence"))


def latest(log: DataFrame, key: str, at: str) -> DataFrame:
    """SNK-04: the last row of each key of an append-only log; of equal times the greatest row."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("_r")).select(key, "_r.*")


def without_documents(tables: dict[str, DataFrame], docs: DataFrame, key: str = "doc_id") -> dict[str, DataFrame]:
    """SNK-06: all tables without the rows of some documents."""
    return {n: df.join(docs.select(key).distinct(), key, "left_anti") for n, df in tables.items()}


def snapshot(tables: dict[str, DataFrame], folder: str) -> None:
    """SNK-07: all tables to one folder; a second run gives the same."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def purge(spark: SparkSession, folder: str, keep: tuple[str, ...] = ("ledger",)) -> DataFrame:
    """SNK-15: delete all tables of a folder but the kept ones (the ledger of spending); table and rows of each that went. Counts are taken first, so a failure before leaves all as it was."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = {x.getPath().getName().removesuffix(".parquet"): x.getPath() for x in files.listStatus(root)}
    gone = [(name, spark.read.parquet(path.toString()).count()) for name, path in sorted(paths.items()) if name not in keep]
    for name, _ in gone:
        files.delete(paths[name], True)
    return spark.createDataFrame(gone, "table string, rows long")


def write_lines(df: DataFrame, path: str) -> None:
    """SNK-11: JSON lines."""
    df.write.mode("overwrite").json(path)


# What heads an import file of cards.
DIRECTIVES = ("#separator:Comma", "#html:true", "#columns:Front,Back")


def card_lines(nodes: DataFrame, description: Column, source: Column, statement: Column, page: Column, tag: str) -> DataFrame:
    """SNK-12: (place, line) of an import file: directives, then quoted front and back of each card; lines end in CR LF when written."""
    small = lambda x: F.concat(F.lit("<small>"), x, F.lit("</small>"))
    where = S.escaped(F.coalesce(source, F.lit("Source document")))
    front = F.concat(S.escaped(description), F.lit("<br>"), small(where))
    back = F.concat(S.card_html(statement), F.lit("<br><br>"), small(F.concat(where, F.lit(" · p. "), page.cast("string"))))
    rows = nodes.select(F.col("place").cast("long").alias("place"), F.concat_ws(",", S.csv_field(front), S.csv_field(back)).alias("line"))
    head = nodes.sparkSession.createDataFrame([(i - 4, d) for i, d in enumerate((*DIRECTIVES, f"#tags:{tag}"))], "place long, line string")
    return head.unionByName(rows)


def appended(df: DataFrame, path: str) -> None:
    """SNK-13: rows behind a ledger's."""
    df.write.mode("append").parquet(path)


def changed(before: DataFrame, now: DataFrame, keys: list[str]) -> DataFrame:
    """SNK-14: rows that are new or differ from what was sent before."""
    rest = [c for c in now.columns if c not in keys]
    old = before.select(*keys, F.struct(*rest).alias("_o"))
    return now.join(old, keys, "left").where(~F.struct(*rest).eqNullSafe(F.col("_o"))).select(now.columns)
