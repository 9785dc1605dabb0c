"""Sources (SRC): files and tables as DataFrames of the graph model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BOX = "array<double>"
SPAN = f"doc string, text string, page int, bbox {BOX}, font string, size double, bold boolean, italic boolean, block int, line int"
#: One document with its graph per file.
GOLDEN = (
    "document struct<id:string,corpus_id:string,title:string,filename:string,file_hash:string,page_count:int,quality:double,status:string>, "
    f"nodes array<struct<id:string,doc_id:string,kind:string,label:string,title:string,statement_md:string,clauses:array<struct<id:string,text:string>>,symbols:array<struct<sym:string,role:string>>,page:int,bbox:{BOX},entity_id:string,confidence:double>>, "
    "edges array<struct<src:string,dst:string,kind:string,extractor:string,confidence:double>>, "
    f"anchors array<struct<id:string,doc_id:string,page:int,bbox:{BOX},surface:string,target_node_id:string,target_entity_id:string,card_id:string>>, "
    "cards array<struct<id:string,anchor_id:string,headline:string,instantiated_md:string,full_md:string,substitutions:array<struct<`from`:string,`to`:string>>,clause_ids:array<string>,gloss:string,source:struct<doc_id:string,page:int>>>, "
    "entities array<struct<id:string,corpus_id:string,canonical_node_id:string,name:string>>"
)


def spans(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01: text runs from JSON lines; a run of white space alone joins the run before it on its line. PDF bytes need a parser that writes this form."""
    raw = spark.read.schema(SPAN).json(path)
    return merged_blanks(raw.withColumn("id", F.monotonically_increasing_id()))


def merged_blanks(runs: DataFrame) -> DataFrame:
    """Blank runs appended to the run before; runs: doc, page, line, id, text."""
    w = Window.partitionBy("doc", "page", "line").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    at = runs.withColumn("_g", F.sum((F.trim("text") != "").cast("int")).over(w))
    texts = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]))
    first = F.min_by(F.struct(*[c for c in runs.columns if c != "text"]), "id")
    joined = at.where("_g > 0").groupBy("doc", "page", "line", "_g").agg(first.alias("f"), texts.alias("_t"))
    return joined.select("f.*", F.col("_t").alias("text"))


def files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """SRC-02: path, length and bytes of the files of a folder whose names match."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)


def golden(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """SRC-03: the tables of one-document JSON files."""
    raw = spark.read.schema(GOLDEN).option("multiLine", True).json(path)
    out = {"documents": raw.select("document.*")}
    for name in ("nodes", "edges", "anchors", "cards", "entities"):
        out[name] = raw.select(F.explode(name).alias("x")).select("x.*")
    return out


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """SRC-04: a whole Parquet table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def with_titles(docs: DataFrame, overlay: DataFrame, key: str = "id") -> DataFrame:
    """SRC-05: documents with the titles that a local record gives them."""
    return docs.join(overlay.select(key, F.col("title").alias("_t")), key, "left").withColumn("title", F.coalesce("_t", "title")).drop("_t")


def cached_vectors(nodes: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """SRC-07, SNK-09: nodes with a cached vector, and the distinct contents that still need one."""
    return nodes.join(cache, keys), nodes.join(cache, keys, "left_anti").select(*keys).distinct()


#: Most files, and bytes of a PDF and of a TeX file.
MOST_FILES, MOST_PDF, MOST_TEX = 20, 50 << 20, 2 << 20


def uploads(found: DataFrame) -> DataFrame:
    """SRC-08, SRC-09: files (path, length, content) with the reason why one is refused, or null. TeX is checked, not compiled."""
    name = F.lower("path")
    pdf, tex = name.endswith(".pdf"), name.endswith(".tex")
    head = F.substring("content", 1, 5) == F.lit("%PDF-").cast("binary")
    unsafe = F.regexp_like(F.col("content").cast("string"), F.lit(r"\\(?:write18|input\s*\|)"))
    why = F.when(~pdf & ~tex, "type").when(pdf & (F.col("length") > MOST_PDF) | tex & (F.col("length") > MOST_TEX), "size").when(pdf & ~head, "content").when(tex & unsafe, "unsafe")
    n = F.row_number().over(Window.partitionBy("batch").orderBy("path"))
    return found.withColumn("_n", n).withColumn("why", F.coalesce(why, F.when(F.col("_n") > MOST_FILES, "count"))).drop("_n")


def rough_nodes(items: DataFrame, pattern: str, least: int = 30) -> DataFrame:
    """SRC-10: headings among text items (doc, page, item, text) with the next four items as statement; pages of less text than `least` are unsupported."""
    w = Window.partitionBy("doc", "page").orderBy("item")
    following = F.concat_ws(" ", *[F.lead("text", i).over(w) for i in range(1, 5)])
    size = F.sum(F.length("text")).over(Window.partitionBy("doc", "page"))
    out = items.select("doc", "page", "item", "text", following.alias("statement"), F.when(size < least, "unsupported").otherwise("ready").alias("status"))
    return out.where(F.regexp_like("text", F.lit(pattern)))


def manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """SRC-11: expected edges (src, dst, kind, evidence) of evaluation files; lines: of files with an object a line."""
    raw = spark.read.schema("version int, source string, scope string, source_sha256 string, edges array<array<string>>").option("multiLine", not lines).json(path)
    names = ("src", "dst", "kind", "evidence")
    return raw.select(F.explode("edges").alias("e")).select(*[F.col("e")[i].alias(n) for i, n in enumerate(names)])


def progress_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-12: a progress log of JSON files as a stream."""
    return spark.readStream.schema(schema).json(path)
