"""Texts whose words agree under simple hashes, ids at the ends of their range, and one verification for each pair."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioweave.llm import exchange as ex
from folioweave.llm import jaccard_join, packing, store, substring_dedup, token_counts, token_files, tokens
from folioweave.operators import tables

from .test_ops import WORD, brute_components, by_id, check_pieces

public_tokenizers = pytest.importorskip("public_tokenizers")


def alike(n):
    """Two words of n letters, of the Thue-Morse sequence and its complement, that polynomials modulo 2**64 don't tell apart."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate({97: 98, 98: 97})


PAIRS = [alike(n) for n in (1024, 2048, 4096)]


@pytest.fixture(autouse=True)
def few_groups(monkeypatch):
    monkeypatch.setattr(ex, "LEAST_GROUPS", 4)
    monkeypatch.setattr(token_files, "LEAST_PARTS", 3)


@pytest.fixture(scope="module")
def rows():
    """Documents 2k and 2k + 1 differ in one word of each window and shingle alone."""
    out = []
    for a, b in PAIRS:
        for w in (a, b):
            out.append((len(out), " ".join(x for k in range(8) for x in (w, "p", "q", "r"))))
    return [*out, *[(len(out) + i, w) for i, w in enumerate(w for p in PAIRS for w in p)]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_packing_and_files_of_alike_words(spark, docs, rows):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    check_pieces(packing.pack(docs, path).collect(), rows, Tokenizer.from_file(path))
    path = public_tokenizers.path("word_bpe_49k.json")
    tk, got = Tokenizer.from_file(path), by_id(token_files.read_shards(token_files.write_shards(docs, path).df))
    for i, t in rows:
        ids = [*tk.encode(t, add_special_tokens=False).ids, 2]
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_counts_of_alike_words(docs, rows):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    assert {i: r["n_tokens"] for i, r in by_id(token_counts.count_tokens(docs, path)).items()} == {i: len(sp.encode(t)) for i, t in rows}


def test_dedup_and_join_of_alike_words(docs, rows):
    got = by_id(substring_dedup.substring_dedup(docs))
    for i, t in rows:
        # Windows repeat inside a document only, and that removes nothing.
        assert (got[i]["n_removed"], got[i]["kept_text"]) == (0, " ".join(WORD.findall(t)))
    want, _ = brute_components(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by_id(jaccard_join.jaccard_components(docs)).items()} == want


@pytest.mark.parametrize("words", [True, False])
def test_hashes_that_agree_go_through_the_library(monkeypatch, words):
    """Even hashes that are all alike give the library's ids."""
    name = "word_bpe_49k.json" if words else "byte_bpe_50k.json"
    e = tokens.Encoder(public_tokenizers.path(name), words)
    monkeypatch.setattr(e.hashers[0], "hashes", lambda data, s, t: np.zeros(len(s), np.uint64))
    texts = ["one two  three", "four's 5 six", None, ""]
    ids, bounds = e.batch(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_long_stretches_compose_in_log_rounds():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    t = token_counts.Transducer(token_counts.Merges(path))
    rng = random.Random(3)
    for text in ("a" * 1_000_000, "".join(rng.choice("abcdefgh") for _ in range(1_000_000)), "ab=" * 300_000):
        count = token_counts.batch_counts(pa.array([text]), t, token_counts.Hasher(space=token_counts.ONLY_BLANK))[0]
        assert count == sum(len(sp.encode(text)) for _ in range(1))
        most = (len(text) // token_counts.CHUNK + 2).bit_length()
        assert t.doublings <= most and t.closing <= 2 * most


def test_ids_at_the_ends_of_their_range(spark):
    t, u = " ".join(map(str, range(20))), " ".join(map(str, range(50, 70)))
    top, low = 2**63 - 1, -(2**63)
    df = spark.createDataFrame([(top, t), (None, t), (5, u), (-5, u), (low, u)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.substring_dedup(df).collect()}
    assert got == {(top, 0), (None, 20), (5, 20), (-5, 20), (low, 0)}
    files = token_files.read_shards(token_files.write_shards(df, public_tokenizers.path("word_bpe_49k.json")).df).orderBy("start").collect()
    assert [r["doc_id"] for r in files] == [None, low, -5, 5, top]


def test_rows_without_id_spread(spark):
    texts = [f"w{i} x y z" for i in range(200)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(7, t) for t in texts], "doc_id long, text string")
    sizes = [r["count"] for r in ex.in_groups(df, {}, 8).groupBy("grp", "doc_id").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 60


def test_carried_columns_stay_with_their_rows(spark):
    t = " ".join(map(str, range(20)))
    df = spark.createDataFrame([(1, t, 10), (1, "other  words", 11), (2, t + " end", 20), (None, None, 30)], "doc_id long, text string, k int")
    got = {(r["k"], r["text"]) for r in substring_dedup.substring_dedup(df, carried="k").collect()}
    assert got == {(10, t), (11, "other  words"), (20, "end"), (30, None)}


def test_finished_results_leave_nothing_else(spark):
    """Also the session's settings are as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, 777)
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    there = list(tables.there)
    out = store.finished(spark, lambda: jaccard_join.jaccard_components(df), "result")
    assert [t for t in tables.there if t not in there] == [out] and out.df.count() == 2
    assert spark.conf.get(key) == "777"
    spark.conf.unset(key)
    out.drop()
    assert tables.there == there


def test_pairs_are_verified_once(spark, monkeypatch):
    """Many components that share frequent shingles: all links are found, no pair is verified twice, and blocks are small."""
    rng, made = random.Random(8), {}
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    real = jaccard_join.stage
    monkeypatch.setattr(jaccard_join, "stage", lambda df, label, *more: made.setdefault(label, real(df, label, *more)))  # labels differ
    passage = [f"p{i}" for i in range(30)]
    data = []
    for i in range(120):
        own = [f"o{rng.randrange(40)}" for _ in range(rng.randint(2, 12))]
        data.append((i, " ".join(passage[: rng.randint(18, 30)] + own)))
    want, links = brute_components(data)
    got = by_id(jaccard_join.jaccard_components(spark.createDataFrame(data, "doc_id long, text string")))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want and links > 50
    tried = [tuple(r) for k in (1, 2, 3) for r in made[f"pairs-{k}"].df.select(F.col("a"), F.col("b")).collect()]
    assert len(tried) == len({tuple(sorted(p)) for p in tried}) > 0
    assert made["blocks"].df.where("xs > 1").count() > 0


def test_parts_of_several_shards(docs, rows, monkeypatch):
    """Small shards, so that a part has many: the same rows, and counts of a token over all of them."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tk = Tokenizer.from_file(path)
    monkeypatch.setattr(token_files, "SHARD_TOKENS", 50)
    monkeypatch.setattr(token_files, "LEAST_PARTS", 1)
    many = docs.unionByName(docs.select((F.col("doc_id") + 100).alias("doc_id"), F.lit("a few words").alias("text"))).unionByName(docs.sparkSession.createDataFrame([(200 + i, f"number {i} " * 30) for i in range(1200)], docs.schema))
    files = token_files.write_shards(many, path).df
    assert files.groupBy("part").count().where("count > 1").count() > 0
    at = 0
    for r in token_files.read_shards(files).orderBy("doc_id").collect():
        assert r["start"] == at
        at += r["n_tokens"]
    texts = [t for _, t in rows] + ["a few words"] * len(rows) + [f"number {i} " * 30 for i in range(1200)]
    ids = [[*tk.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    assert at == sum(map(len, ids))
    token = tk.encode("number", add_special_tokens=False).ids[0]
    assert sum(r["n"] for r in token_files.locate(files, token).collect()) == sum(x.count(token) for x in ids)


def test_kept_hash_is_of_kept_words(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, t), (2, f"a {t} b")], "doc_id long, text string")
    got = by_id(substring_dedup.substring_dedup(df))
    assert hashlib.sha256(got[2]["kept_text"].encode()).hexdigest() == hashlib.sha256(b"a b").hexdigest()
