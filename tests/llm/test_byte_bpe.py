"""Byte-level BPE against the library of the rank file, and round trips."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioweave.llm import byte_bpe, queries

from .test_ops import by_id, docs, empty, rows, texts  # noqa: F401

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def same(ranks, library, some):
    ids, bounds = ranks.batch(pa.array(some, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [library.encode_ordinary(t or "") for t in some]
    flat, at = ranks.decoded(ids.astype(np.int32), bounds)
    assert [flat[a:b].tobytes() for a, b in zip(at, at[1:], strict=False)] == [(t or "").encode() for t in some]


def test_all_rows(docs, rows, library):  # noqa: F811
    """Nulls, empty and long texts, repeated rows, special strings and columns of other names."""
    got = by_id(byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), decoded=True))
    assert {i: (r["ids"], bytes(r["decoded"])) for i, r in got.items()} == {i: (library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60) | st.text("aAeE tThH'sdlr\n", max_size=200), max_size=4))
def test_any_text(ranks, library, some):
    same(ranks, library, some)


@pytest.mark.parametrize("letters", ["ab", "abc", "etaoin", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!?.-_=", "äöüß日本"])
def test_long_words(ranks, library, letters):
    rng = random.Random(len(letters))
    same(ranks, library, ["".join(rng.choice(letters) for _ in range(n)) for n in (63, 64, 65, 66, 130, 400, 1500)])


def test_very_long_texts(ranks, library):
    t = "".join(random.Random(4).choice("abcdefghijklmnop") for _ in range(60_000))
    same(ranks, library, [t, "word " * 400_000, "a" * 50_000])


def test_rounds_go_on_in_the_next_query(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LONG_ROUNDS", byte_bpe.LONG_ROUNDS.replace(f"round < {byte_bpe.CALL_ROUNDS}", "round < 2").replace(f"round = {byte_bpe.CALL_ROUNDS}", "round = 2"))
    same(ranks, library, ["abba" * 40 + "cab" * 30, "x" * 700])


def test_words_whose_hashes_agree(ranks, library, monkeypatch):
    for memo in (ranks.memo, ranks.back):
        monkeypatch.setattr(memo.hashers[0], "hashes", lambda data, s, t: np.zeros(len(s), np.uint64))
    same(ranks, library, ["one two  three", "four's 5 six", None, ""])


def test_words_are_forgotten_at_a_bound(ranks, library, monkeypatch):
    from folioweave.llm import tokens

    monkeypatch.setattr(tokens, "MOST_WORDS", 50)
    for seed in range(4):
        same(ranks, library, [t for t in texts(seed, 10) if len(t or "") < 2000])


def test_ids_that_come_from_elsewhere(spark, library):
    """decode() alone: null and empty lists, a cut inside a character, an id that is not in the vocabulary."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ids = library.encode_ordinary("日本 end")
    df = spark.createDataFrame([(1, ids, 0), (None, None, 1), (1, [], 2), (2, ids[:1], 3)], "doc_id long, ids array<int>, decoded int")
    got = sorted((r["doc_id"] or 0, bytes(r["decoded"])) for r in byte_bpe.decode(df, path).collect())
    assert got == sorted([(1, "日本 end".encode()), (0, b""), (1, b""), (2, library.decode_bytes(ids[:1]))])
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(spark.createDataFrame([(1, [60000])], "doc_id long, ids array<int>"), path).collect()


def test_query_and_empty_table(spark, docs, rows, library, tmp_path):  # noqa: F811
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(queries.op13_byte_bpe(spark, str(tmp_path)))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        assert got[i].asDict() == {"doc_id": i, "n_tokens": len(ids), "ids_sha256": sha(" ".join(map(str, ids)).encode()), "decoded_sha256": sha((t or "").encode())}
    assert byte_bpe.encode(empty(spark), public_tokenizers.path("byte_bpe_50k.tiktoken")).isEmpty()
