"""BM25 scored where the nodes are, and segments whose tasks grow with their words."""

from pyspark.sql import functions as F

from folioweave.operators import retrieval, segments

FIELDS, BOOSTS = ["title", "body"], {"title": 3.0, "body": 1.0}


def corpus(spark):
    """Words of few letters, so that scores tie; a null text, ids that come again with texts of one size and of others."""
    texts = [(i, f"n{i % 3} n{i % 5}", " ".join(f"w{(i * k) % 7}" for k in range(1, 2 + i % 6))) for i in range(60)]
    texts += [(3, "n1 n1", "w1 w2"), (3, "n1", "w1"), (70, "n1", None), (71, None, "w5 w5 w5")]
    return spark.createDataFrame(texts, "id long, title string, body string")


def asked(spark):
    return spark.createDataFrame([(1, "w1 w2 n1"), (2, "w5 n2 n2"), (3, "nothing"), (None, "w3 W1")], "q long, text string")


def rows(df):
    return sorted((-1 if r["q"] is None else r["q"], r["rank"], r["id"], r["score"]) for r in df.collect())


def test_scores_of_tasks_are_those_of_the_join(spark, monkeypatch):
    nodes, queries = corpus(spark).repartition(3), asked(spark)
    sizes, terms = retrieval.field_sizes(nodes, FIELDS), queries.select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    for postings in (retrieval.index(nodes, FIELDS), retrieval.index(nodes, FIELDS, terms), retrieval.counted(nodes, FIELDS, terms)):
        with monkeypatch.context() as m:
            m.setattr(retrieval, "CELLS", 30)  # a node or two at a time
            m.setattr(retrieval, "FEW", 100)
            got = rows(retrieval.bm25(postings, sizes, queries, BOOSTS, 8, digits=9))
            m.setattr(retrieval, "FEW", 1)
            want = rows(retrieval.bm25(postings, sizes, queries, BOOSTS, 8, digits=9))
        assert got == want and len(got) == 24


def test_more_words_than_few_are_joined(spark, monkeypatch):
    nodes, terms = corpus(spark), spark.createDataFrame([("w1",), ("n2",), ("w5",)], "w string")
    want = sorted(map(tuple, retrieval.index(nodes, FIELDS, terms).collect()))
    monkeypatch.setattr(retrieval, "FEW", 2)
    assert sorted(map(tuple, retrieval.index(nodes, FIELDS, terms).collect())) == want


def test_pairs_of_queries_and_nodes_are_not_shuffled(spark):
    """Hits that meet only to be ranked: one exchange, behind a limit, and no sum by query."""
    nodes, queries = corpus(spark), asked(spark)
    hits = retrieval.bm25(retrieval.counted(nodes, FIELDS), retrieval.field_sizes(nodes, FIELDS), queries, BOOSTS, 8)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan


def test_segments_grow_in_pieces_and_leave_single_texts_where_they_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "ROWS_A_TASK", 5)
    nodes = corpus(spark).where("id <> 3")
    index = segments.Segments(spark, f"file://{tmp_path}/index", FIELDS, 2)
    assert "Exchange" not in index._one_each(nodes)._jdf.queryExecution().executedPlan().toString()
    index.add(nodes)
    assert len(list(tmp_path.glob("index/*/postings/bucket=0/*.parquet"))) > 4
    sizes, queries = retrieval.field_sizes(nodes, FIELDS), asked(spark)
    assert rows(index.search(queries, BOOSTS, 8, digits=9)) == rows(retrieval.bm25(retrieval.index(nodes, FIELDS), sizes, queries, BOOSTS, 8, digits=9))


def test_of_repeated_ids_the_least_counts(spark, tmp_path, monkeypatch):
    index = segments.Segments(spark, f"file://{tmp_path}/index", FIELDS, 2)
    nodes = corpus(spark)
    for many in (100, 0):
        monkeypatch.setattr(segments, "REPEATED", many)
        got = sorted((r["id"], r["title"] or "", r["body"] or "") for r in index._one_each(nodes).collect())
        assert len(got) == 62 and (3, "n0 n3", "w3") not in got and (3, "n0 n3", "w3 w6 w2 w5") in got
