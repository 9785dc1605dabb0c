"""The pipeline's stages, each against a brute-force version of its decision on its own input."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioweave.llm import exchange as ex
from folioweave.llm.store import stage

from .test_ops import brute_components, brute_dedup, check_pieces, words

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


def test_stages(spark, monkeypatch):
    monkeypatch.setattr(ex, "LEAST_GROUPS", 4)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    inputs, columns = [docs], docs.columns
    for name, function in corpus_pipeline.STAGES:
        inputs.append(stage(function(spark, inputs[-1], FOLDER), name).df)
    assert all(d.columns == columns for d in inputs[:-1])
    rows = [{r["doc_id"]: r for r in d.collect()} for d in inputs[:-1]]
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    clean = {i for i, r in labels.items() if r["quality"] and not r["toxic"]}
    assert set(rows[1]) < set(rows[0]) and len(clean & set(rows[1])) >= 0.95 * len(clean)
    pairs = lambda k: [(i, r["text"]) for i, r in rows[k].items()]
    component, _ = brute_components(pairs(1))
    assert set(rows[2]) == {c for _, c in component.values()}
    removed = brute_dedup(pairs(2))
    assert set(rows[3]) == set(rows[2])
    for i, r in rows[3].items():
        n, gone, _ = removed[i]
        assert len((r["text"] or "").split()) == n - gone and (gone or r["text"] == rows[2][i]["text"])
    items = [words(r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    index = [shingles(w) for w in items]
    bad = {i for i, r in rows[3].items() if any(s and 100 * len(s & shingles(words(r["text"]))) >= 75 * len(s) for s in index)}
    assert set(rows[4]) == set(rows[3]) - bad
    import public_tokenizers
    from tokenizers import Tokenizer

    used, least = check_pieces(inputs[-1].collect(), pairs(4), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert used <= least + 1


def test_empty_table(spark, monkeypatch):
    monkeypatch.setattr(ex, "LEAST_GROUPS", 4)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for name, function in corpus_pipeline.STAGES:
        docs = stage(function(spark, docs, FOLDER), name).df
    assert docs.isEmpty()


def test_null_rows_stay_or_go_as_defined(spark, monkeypatch):
    monkeypatch.setattr(ex, "LEAST_GROUPS", 4)
    t = " ".join(f"word{i}" for i in range(30))
    docs = spark.createDataFrame([(1, t, "en", "s", 1), (1, t, "en", "s", 1), (2, t, None, None, None), (None, t, "en", "s", 1), (3, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, FOLDER)
    assert sorted((r["doc_id"] or -1) for r in got.collect()) == [-1, 1, 3]
    changed = corpus_pipeline.repeated_passages(spark, got, FOLDER).where("doc_id IS NULL").select(F.length("text")).first()
    assert changed[0] == len(t)


def test_rows_without_id_are_judged_each(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 60").first()["text"]
    kept = corpus_pipeline.quality(spark, docs, FOLDER)
    good, bad = kept.limit(5), docs.join(kept, "doc_id", "left_anti").limit(5)
    bare = lambda df: df.withColumn("doc_id", F.lit(None).cast("long"))
    texts = lambda df: {r["text"] for r in df.where("doc_id IS NULL").collect()}
    mixed = docs.unionByName(bare(good)).unionByName(bare(bad))
    stays = texts(corpus_pipeline.quality(spark, mixed, FOLDER))
    assert stays & texts(bare(good)) and not texts(bare(bad)) <= stays
    rows = spark.createDataFrame([(None, item), (None, "no item here"), (1, item), (2, "none")], "doc_id long, text string")
    assert {(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminated(spark, rows, FOLDER).collect()} == {(None, "no item here"), (2, "none")}


def test_rows_of_one_id_keep_their_own_texts(spark, monkeypatch):
    """An id that repeats with different texts, in all stages."""
    monkeypatch.setattr(ex, "LEAST_GROUPS", 4)
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    shared = " ".join(f"w{i}" for i in range(20))
    own = " ".join(f"x{i}" for i in range(40))
    row = lambda i, t, lang="en": (i, t, lang, "s", len(t or ""))
    # Unrelated texts of one id are no duplicates; of a copy under two ids the smaller one stays; equal rows are one.
    docs = spark.createDataFrame([row(2, shared), row(2, own), row(2, own), row(5, shared), row(None, shared), row(3, "")], kinds)
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, FOLDER).collect()]
    assert sorted(got, key=str) == sorted([(2, shared), (2, own), (None, shared), (3, "")], key=str)
    # Only the row that holds the passage of a smaller id changes.
    docs = spark.createDataFrame([row(1, shared), row(2, f"{shared} tail", "de"), row(2, f"  {own}"), row(None, shared), row(4, None)], kinds)
    got = {(r["doc_id"], r["text"], r["lang"], r["n_chars"]) for r in corpus_pipeline.repeated_passages(spark, docs, FOLDER).collect()}
    assert got == {(1, shared, "en", len(shared)), (2, "tail", "de", 4), (2, f"  {own}", "en", len(own) + 2), (None, shared, "en", len(shared)), (4, None, "en", 0)}
    # A contaminated row goes, the other of its id stays.
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").where("length(text) > 60").first()["text"]
    docs = spark.createDataFrame([row(2, item), row(2, own), row(None, f"a {item} b"), row(None, own)], kinds)
    got = {(r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminated(spark, docs, FOLDER).collect()}
    assert got == {(2, own), (None, own)}
    # Each row of an id is judged by itself.
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, FOLDER)
    good, bad = kept.limit(3), docs.join(kept, "doc_id", "left_anti").limit(3)
    same = lambda df: df.withColumn("doc_id", F.lit(10**9))
    stays = {r["text"] for r in corpus_pipeline.quality(spark, docs.unionByName(same(good)).unionByName(same(bad)), FOLDER).where("doc_id = 1000000000").collect()}
    assert stays & {r["text"] for r in good.collect()} and not {r["text"] for r in bad.collect()} <= stays
