"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioweave.llm.decontaminate import contained_items
from folioweave.llm.jaccard_join import jaccard_components
from folioweave.llm.packing import pack
from folioweave.llm.quality import accepted
from folioweave.llm.queries import _tokenizer
from folioweave.llm.store import finished, numbered, picked
from folioweave.llm.substring_dedup import substring_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Each row is judged by itself, also where ids repeat or are null; null and empty texts are judged as texts without words, long ones whole."""
    rows = docs.withColumn("_doc", F.struct(*docs.columns))
    return accepted(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), carried="_doc").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of each group of near duplicates; texts without words and documents without an id stay. Rows that repeat an id are compared each by itself."""
    rows = numbered(docs)
    named = rows.where("doc.doc_id IS NOT NULL")
    found = jaccard_components(named.select("row", "doc.text"), id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    first = found.join(named.select("row", "doc.doc_id"), "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    stays = first.select("first.row").unionByName(rows.where("doc.doc_id IS NULL").select("row"))
    return picked(rows, stays, keep=True)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str, unnamed_last: bool = False) -> DataFrame:
    """All documents, each row without the passages that also stand in a document of a smaller id. Those without an id are left as they are; unnamed_last: they come after all ids, so their repeated passages go, too."""
    named = (docs if unnamed_last else docs.where("doc_id IS NOT NULL")).withColumn("_doc", F.struct(*[c for c in docs.columns if c != "text"]))
    changed = substring_dedup(named, carried="_doc")
    columns = {c: F.col(f"_doc.{c}") for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(columns["n_chars"])
    out = changed.select([columns[c].alias(c) for c in docs.columns])
    return out if unnamed_last else out.unionByName(docs.where("doc_id IS NULL"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item. Each row is judged by itself, also where ids repeat or are null; null and empty texts contain none, long ones are searched whole."""
    rows = numbered(docs)
    found = contained_items(rows.select("row", "doc.text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return picked(rows, found.select(F.col("doc_id").alias("row")), keep=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences; null and empty texts are a piece of the end id alone, long ones are cut and lose nothing."""
    return pack(docs, _tokenizer("byte_bpe_50k.json"), length=1024, end_id=2)


#: What goes on to training repeats no passage, with or without an id.
STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", partial(repeated_passages, unnamed_last=True)), ("decontaminated", decontaminated), ("packed", packed)]

#: The classifier and the linear program can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, function in STAGES:
        now = finished(spark, lambda f=function, d=docs: f(spark, d, sf_dir), f"pipeline-{name}")
        if before:
            before.drop()
        docs, before = now.df, now
    return docs
