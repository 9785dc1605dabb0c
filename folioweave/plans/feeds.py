"""Queries of sources, sinks and feeds."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from ..operators.tables import folder, saved
from ..sources import pdf, readers, sinks
from ..streaming import feeds
from . import adapters as V
from .registry import query
from .scalars import BUDGET


@contextmanager
def rocks_db(spark):
    """Keyed state needs this store; the session's own setting comes back behind the stream."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _folder(t, name: str) -> str:
    return folder(t.spark, name)


@query("whole_table", "SRC-04", "SELECT * FROM customer")
def whole_table(t):
    return readers.table(t.spark, t.folder, "customer")


@query("merged_runs", "SRC-01 SNK-11", f"WITH {V.TURNS}, r AS (SELECT doc, pos, count(*) FILTER (length(statement) >= 200) OVER (PARTITION BY doc ORDER BY pos) AS g, CASE WHEN length(statement) < 200 THEN ' ' ELSE statement END AS x FROM turns) SELECT doc::VARCHAR AS doc, string_agg(x, '' ORDER BY pos) AS text FROM r WHERE g > 0 GROUP BY doc, g")
def merged_runs(t):
    runs = V.turns(t).select(F.col("doc").cast("string").alias("doc"), F.when(F.length("statement") < 200, " ").otherwise(F.col("statement")).alias("text"), F.lit(1).alias("page"), F.lit(1).alias("line"), F.col("pos").alias("id"))
    path = _folder(t, "runs")
    sinks.write_lines(runs, path)
    return readers.merged_blanks(t.spark.read.schema(runs.schema).json(path)).select("doc", "text")


#: What stands before a page's stream: objects 1, 2, 3 and 5, whose places are therefore known.
PDF_HEAD = [
    "%PDF-1.4\n",
    "1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj\n",
    "2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>> endobj\n",
    "3 0 obj <</Type/Page/Parent 2 0 R/MediaBox[0 0 612 792]/Contents 4 0 R/Resources<</Font<</F1 5 0 R>>>>>> endobj\n",
    "5 0 obj <</Type/Font/Subtype/Type1/BaseFont/Courier-Bold/Encoding/WinAnsiEncoding>> endobj\n",
]


def _pdf(content):
    """The bytes of a file of one page, as a column."""
    at = [sum(map(len, PDF_HEAD[:i])) for i in range(1, 6)]
    places = "".join(f"{p:010d} 00000 n \n" for p in (at[0], at[1], at[2], at[4], at[3]))
    body = F.concat(F.lit("4 0 obj <</Length "), F.length(content).cast("string"), F.lit(">> stream\n"), content, F.lit("\nendstream endobj\n"))
    end = F.concat(F.lit("xref\n0 6\n0000000000 65535 f \n" + places + "trailer <</Size 6/Root 1 0 R>>\nstartxref\n"), (F.length(body) + at[4]).cast("string"), F.lit("\n%%EOF\n"))
    return F.concat(F.lit("".join(PDF_HEAD)), body, end).cast("binary")


@query(
    "pdf_runs",
    "SRC-01 SRC-02 ANC-05",
    """SELECT p_partkey::VARCHAR AS doc, 0 AS line, p_name AS text, 72.0::DOUBLE AS x0, round(72 + 7.2 * length(p_name), 6)::DOUBLE AS x1, true AS bold FROM part
UNION ALL SELECT p_partkey::VARCHAR, 1, p_brand || ' x', 72.0, round(72 + 7.2 * (length(p_brand) + 2), 6), true FROM part UNION ALL SELECT p_partkey::VARCHAR, NULL, 'code 129 of Courier-Bold', NULL, NULL, NULL FROM part WHERE p_size = 7""",
)
def pdf_runs(t):
    odd = F.when(F.col("p_size") == 7, F.lit("0 -300 Td (\\201) Tj ")).otherwise("")
    content = F.concat(F.lit("BT /F1 12 Tf 72 700 Td ("), "p_name", F.lit(") Tj 0 -14 Td [("), "p_brand", F.lit(") -600 (x)] TJ "), odd, F.lit("ET"))
    # A small file of keys stands for many PDF files: they are dealt to tasks before they are made, and read once for runs and problems.
    tasks = max(t.spark.sparkContext.defaultParallelism, -(-t.part.count() // 5000))
    files = t.part.repartition(tasks, "p_partkey").select(F.col("p_partkey").cast("string").alias("path"), _pdf(content).alias("content"))
    texts = saved(pdf.page_texts(pdf.pages(files), tasks), "runs")
    runs = pdf.runs(texts).where("line < 2").select("doc", "line", "text", "x0", F.round("x1", 6).alias("x1"), "bold")
    none = pdf.problems(texts).select("doc", F.lit(None).cast("int").alias("line"), F.col("problem").alias("text"), F.lit(None).cast("double").alias("x0"), F.lit(None).cast("double").alias("x1"), F.lit(None).cast("boolean").alias("bold"))
    return runs.unionByName(none)


@query("title_overlay", "SRC-05", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size < 25 THEN p_brand END, p_name) AS title FROM part")
def title_overlay(t):
    docs = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return readers.with_titles(docs, t.part.where("p_size < 25").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("title")))


@query("missing_vectors", "SRC-07 SNK-09", "SELECT DISTINCT sha256(text) AS h FROM documents WHERE text IS NOT NULL EXCEPT SELECT sha256(text) FROM documents WHERE lang = 'en'")
def missing_vectors(t):
    hashed = t.documents.where("text IS NOT NULL").select("lang", F.sha2("text", 256).alias("h"))
    return readers.cached_vectors(hashed.select("h"), hashed.where("lang = 'en'").select("h").distinct(), ["h"])[1]


@query("upload_checks", "SRC-02 SRC-08 SRC-09", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'content' WHEN 2 THEN 'type' ELSE 'unsafe' END AS why FROM part")
def upload_checks(t):
    k = F.col("p_size") % 4
    name = F.when(k < 2, ".pdf").when(k == 2, ".exe").otherwise(".tex")
    content = F.when(k == 0, "%PDF-1.7").when(k == 1, "hello").otherwise("\\write18{ls}")
    return readers.uploads(t.part.select("p_partkey", F.concat(F.col("p_partkey").cast("string"), name).alias("path"), F.col("p_partkey").alias("batch"), F.length(content).alias("length"), content.cast("binary").alias("content"))).select("p_partkey", "why")


@query("rough_nodes", "SRC-10", f"WITH {V.LINES}, l AS (SELECT *, concat_ws(' ', lead(line, 1) OVER w, lead(line, 2) OVER w, lead(line, 3) OVER w, lead(line, 4) OVER w) AS statement, CASE WHEN sum(length(line)) OVER (PARTITION BY doc_id, page) < 30 THEN 'unsupported' ELSE 'ready' END AS status FROM lines WINDOW w AS (PARTITION BY doc_id, page ORDER BY pos)) SELECT doc_id AS doc, page, pos AS item, statement, status FROM l WHERE regexp_matches(line, '^The ')")
def rough_nodes(t):
    items = V.lines(t).select(F.col("doc_id").alias("doc"), "page", F.col("pos").alias("item"), F.col("line").alias("text"))
    return readers.rough_nodes(items, "^The ").drop("text")


@query("inserted_rows", "SNK-01", "SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey + 1450, s_name FROM supplier WHERE s_suppkey + 1450 NOT IN (SELECT c_custkey FROM customer)")
def inserted_rows(t):
    return sinks.inserted(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t.supplier.select((F.col("s_suppkey") + 1450).alias("id"), F.col("s_name").alias("name")), ["id"])


@query("upserted_rows", "SNK-02", "SELECT o_custkey, o_orderkey, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderstatus = 'F' DESC, o_orderkey DESC) = 1")
def upserted_rows(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    one = sinks.latest(rows.where("o_orderstatus <> 'F'").drop("o_orderstatus"), "o_custkey", "o_orderdate")
    two = sinks.latest(rows.where("o_orderstatus = 'F'").drop("o_orderstatus"), "o_custkey", "o_orderdate")
    return sinks.upserted(one, two.select(one.columns), ["o_custkey"], "o_orderdate")


@query("strengthened_edges", "SNK-03", "WITH a AS (SELECT l_partkey AS src, l_suppkey AS dst, 'k' AS kind, 'old' AS extractor, max(l_discount) AS confidence FROM lineitem GROUP BY ALL), b AS (SELECT l_partkey AS src, l_suppkey + (l_quantity > 25)::INT AS dst, 'k' AS kind, 'new' AS extractor, max(l_tax) AS confidence FROM lineitem GROUP BY ALL) SELECT src, dst, kind, coalesce(a.extractor, b.extractor) AS extractor, greatest(a.confidence, b.confidence) AS confidence FROM a FULL JOIN b USING (src, dst, kind)")
def strengthened_edges(t):
    rows = t.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("k").alias("kind"), "l_discount", "l_tax", "l_quantity")
    a = rows.groupBy("src", "dst", "kind").agg(F.max("l_discount").alias("confidence")).withColumn("extractor", F.lit("old"))
    b = rows.withColumn("dst", F.col("dst") + (F.col("l_quantity") > 25).cast("int")).groupBy("src", "dst", "kind").agg(F.max("l_tax").alias("confidence")).withColumn("extractor", F.lit("new"))
    return sinks.strengthened(a, b)


LAST = "SELECT user_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) = 1"


@query("progress_now", "STM-01 SNK-04", LAST)
def progress_now(t):
    return feeds.progress_now(t.events.select("user_id", "event_type", "ts"), "user_id", "ts")


@query("progress_stream", "STM-01 SRC-12 SNK-14", LAST)
def progress_stream(t):
    """The same state, by micro-batches from files: what was sent, replayed over what was sent before, is the state."""
    rows = t.events.select("user_id", "event_type", F.col("ts").cast("string").alias("ts"))
    folder = _folder(t, "progress")
    rows.repartition(3, "user_id").write.json(folder + "/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(folder + "/in")
    run = feeds.emit_changes(stream, ["user_id"], "ts", lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out/{i}"), folder + "/check", folder + "/state")
    run.awaitTermination()
    sent = t.spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(folder + "/out")
    return sinks.latest(sent, "user_id", "ts").select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("spending_stream", "STM-05 UDF-01", f"WITH RECURSIVE {BUDGET} SELECT user_id, \"at\", id, kind, amount, outcome, committed FROM b WHERE k > 0")
def spending_stream(t):
    """budget_log as a stream: events arrive out of order in three batches, and a batch far ahead moves the watermark over all of them."""
    e = t.events.select("user_id", F.col("event_id").alias("at"), (F.col("event_id") % 5).alias("id"), F.when(F.col("event_type").isin("click", "view"), "reserve").otherwise("settle").alias("kind"), F.floor(F.col("value") * 100).alias("amount"))
    rows = e.select(F.col("user_id").cast("long").alias("user_id"), (F.col("at") + 1).cast("long").alias("at"), F.col("id").cast("long").alias("id"), "kind", F.col("amount").cast("long").alias("amount"))
    path = folder(t.spark, "spending")
    for i in range(3):
        rows.where(F.pmod(F.xxhash64("at"), F.lit(3)) == i).coalesce(1).write.mode("append").json(f"{path}/in")
    ahead = t.spark.range(2).select(F.lit(-1).cast("long").alias("user_id"), (F.lit(10**12) + F.col("id")).alias("at"), F.col("id"), F.lit("reserve").alias("kind"), F.lit(1).cast("long").alias("amount"))
    for i in range(2):
        ahead.where(F.col("id") == i).coalesce(1).write.mode("append").json(f"{path}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).json(f"{path}/in")
    with rocks_db(t.spark):
        out = feeds.spending_stream(stream, "user_id", 100_000, late="30 days")
        out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/out").where("key >= 0").withColumnRenamed("key", "user_id").withColumn("at", F.col("at") - 1)


@query("without_documents", "SNK-06", "SELECT o_orderkey AS doc_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def without_documents(t):
    gone = t.customer.where("c_mktsegment = 'BUILDING'").join(t.orders, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("doc_id"))
    return sinks.without_documents({"o": t.orders.select(F.col("o_orderkey").alias("doc_id"))}, gone)["o"]


@query("appended_ledger", "SNK-13", f"WITH {V.LEDGER} SELECT id, stage, cost FROM ledger")
def appended_ledger(t):
    """Calls by stage, each appended behind those that are there."""
    path = folder(t.spark, "ledger")
    rows = V.ledger(t).select("id", "stage", "cost")
    for stage in ("click", "view"):
        sinks.appended(rows.where(F.col("stage") == stage), path)
    sinks.appended(rows.where(~F.coalesce(F.col("stage").isin("click", "view"), F.lit(False))), path)
    return t.spark.read.parquet(path)


@query("snapshot", "SNK-07", "SELECT c_custkey, c_name FROM customer")
def snapshot(t):
    folder = _folder(t, "snapshot")
    for _ in range(2):
        sinks.snapshot({"customer": t.customer}, folder)
    return readers.table(t.spark, folder, "customer").select("c_custkey", "c_name")


@query("purged", "SNK-15", "SELECT 'customer' AS table, count(*) AS rows FROM customer UNION ALL SELECT 'orders', count(*) FROM orders")
def purged(t):
    folder = _folder(t, "purge")
    sinks.snapshot({"customer": t.customer, "orders": t.orders, "ledger": V.ledger(t)}, folder)
    out = sinks.purge(t.spark, folder)
    if readers.table(t.spark, folder, "ledger").isEmpty():
        raise ValueError("the ledger went, too")
    return out


@query(
    "relayed",
    "STM-08",
    """WITH m AS (SELECT user_id, event_id, (value * 700)::BIGINT AS n, sum((value * 700)::BIGINT) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, n % 2 <> 0 OR n > 32768 OR s > 960000 AS bad FROM m), l AS (SELECT *, coalesce(bool_or(bad OR s = 960000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS over FROM b),
k AS (SELECT *, CASE WHEN over THEN 'late' WHEN bad THEN 'closes' ELSE 'sent' END AS state FROM l) SELECT user_id, event_id, state, coalesce(sum(n) FILTER (state = 'sent') OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) / 32000 AS seconds FROM k""".replace("(value * 700)::BIGINT", "floor(value * 7)::BIGINT * 2"),
)
def relayed(t):
    sizes = t.events.select("user_id", "event_id", (F.floor(F.col("value") * 7) * 2).alias("n"))
    return feeds.relayed(sizes, ["user_id"], ["event_id"], "n").select("user_id", "event_id", "state", "seconds")


@query("dwell", "STM-02", "WITH g AS (SELECT user_id, least(floor(coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) / 1000), 1500) AS ms FROM events) SELECT user_id, sum(ms)::BIGINT AS dwell_ms, sum(ms) >= 4000 AS seen FROM g GROUP BY user_id")
def dwell(t):
    return feeds.dwell(t.events.select("user_id", "ts", F.col("event_id").alias("id")), ["user_id"], "ts")


STATE = "s AS (SELECT user_id AS id, count(*) FILTER (event_type = 'click') AS hover_count, count(*) FILTER (event_type = 'error') % 2 = 1 AS known, count(*) FILTER (event_type = 'view') > 25 OR count(*) FILTER (event_type = 'error') % 2 = 1 AS seen FROM events GROUP BY user_id)"


def _state(t):
    kind = F.when(F.col("event_type") == "click", "hover").when(F.col("event_type") == "error", "toggle").when(F.col("event_type") == "view", "seen")
    return feeds.reader_state(t.events.select(F.col("user_id").alias("id"), kind.alias("kind")), ["id"])


@query("reader_state", "STM-03", STATE.replace("s AS (", "").replace("count(*) FILTER (event_type = 'view') > 25", "count(*) FILTER (event_type = 'view') > 0").removesuffix(")"))
def reader_state(t):
    return _state(t)


@query("read_coverage", "AGG-14", f"WITH {STATE.replace('> 25', '> 0')} SELECT c_nationkey, count(*) AS nodes, count(*) FILTER (coalesce(seen OR known, false)) AS read, round(count(*) FILTER (coalesce(seen OR known, false)) / count(*), 6) AS share FROM customer LEFT JOIN s ON id = c_custkey GROUP BY c_nationkey")
def read_coverage(t):
    return feeds.read_coverage(t.customer.select(F.col("c_custkey").alias("id"), "c_nationkey"), _state(t), "c_nationkey")


@query("once_each", "STM-04", "SELECT DISTINCT user_id, event_type FROM events")
def once_each(t):
    rows = t.events.select("user_id", "event_type")
    folder = _folder(t, "once")
    rows.repartition(2, "user_id").write.json(folder + "/in")
    stream = t.spark.readStream.schema(rows.schema).json(folder + "/in")
    feeds.once_each(stream, ["user_id", "event_type"]).writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/check").trigger(availableNow=True).start().awaitTermination()
    return saved(t.spark.read.parquet(folder + "/out"))


@query("runnable_documents", "STM-06", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def runnable_documents(t):
    return feeds.runnable(t.documents.select("doc_id"), t.labels)


@query("tumbling_windows", "STM-01", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_windows(t):
    return feeds.windowed(t.events, "ts", "1 hour", "event_type")
