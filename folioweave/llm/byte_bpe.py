"""Byte-level BPE: texts to token ids by merge ranks, and ids to bytes, as recursive DuckDB queries in each partition.

A word (a match of the pattern) is rows of a token and its place, at first one
for each byte. They meet the merge table; each round contracts the leftmost of
a word's pairs of least rank, until no pair of any word is left. Only words that
the worker doesn't know are encoded, a batch of them in one query. Words are cut
where no token of the vocabulary has the two bytes side by side, since no merge
crosses such a place. Pieces of over SHORT bytes contract many pairs a round:
all that nothing can take a part from before their turn (see LONG_ROUND).
Decoding joins ids with the vocabulary and gathers the bytes by place; ids go
by stretches that begin with a blank, each decoded once.

Defined results: null and empty texts have no ids and decode to nothing, ids of
documents may repeat or be null (each row is encoded by itself, no row is moved),
texts may have any length, other columns are left out, an empty table gives no rows.
"""

from __future__ import annotations

import base64
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import trimmed, tune, worker_cache
from .tokens import Encoder, Memo, _classes

SHORT, CALL_BYTES, CALL_ROUNDS, TEXTS = 64, 1 << 17, 48, 500
#: Of a word's number in a row's key; the rest is the place in the word.
PLACES = 1 << 32
#: Any two tokens as one number.
PAIR = 1 << 20

SHORT_ROUNDS = f"""
WITH RECURSIVE s(k, id, live) AS (
  SELECT k, id, true FROM begun
  UNION ALL
  (WITH r AS MATERIALIZED (
     SELECT k, id, c FROM (SELECT k, id, CASE WHEN lead(k) OVER (ORDER BY k) = k + 1 THEN id::BIGINT * {PAIR} + lead(id) OVER (ORDER BY k) END AS pair FROM s WHERE live)
     LEFT JOIN merges USING (pair)),
   b AS (SELECT k // {PLACES} AS word, min(c::BIGINT * {PLACES} + k % {PLACES}) AS least FROM r GROUP BY ALL),
   e AS (SELECT word, word * {PLACES} + least % {PLACES} AS spot FROM b)
   SELECT CASE WHEN k > spot THEN k - 1 ELSE k END, CASE WHEN k = spot THEN c ELSE id END, spot IS NOT NULL
   FROM r JOIN e ON k // {PLACES} = word WHERE spot IS NULL OR k <> spot + 1))
SELECT k // {PLACES} AS word, list(id ORDER BY k) AS ids FROM s WHERE NOT live GROUP BY ALL ORDER BY word
"""

# A pair is contracted when no token that its left neighbour may grow into takes its first part at its rank or before (lefts), none of the right
# takes its second part before (rights), and none takes what it becomes before. In a stretch of pairs of one rank that overlap, every other one
# goes; the left of the later ones is then the merged token. The leftmost pair of least rank always goes.
LONG_ROUNDS = f"""
WITH RECURSIVE s(k, id, live, round) AS (
  SELECT k, id, true, 0 FROM begun
  UNION ALL
  (WITH q AS (
     SELECT k, id, round, k // {PLACES} AS word, lag(id) OVER w AS before, lead(id) OVER w AS after, lead(id, 2) OVER w AS beyond
     FROM s WHERE live AND round < {CALL_ROUNDS} WINDOW w AS (PARTITION BY k // {PLACES} ORDER BY k)),
   p AS (SELECT q.*, c, min(c::BIGINT * {PLACES} + k % {PLACES}) OVER (PARTITION BY word) AS least FROM q LEFT JOIN merges ON pair = id::BIGINT * {PAIR} + after),
   i AS (SELECT *, sum(fresh) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, (c IS DISTINCT FROM lag(c) OVER (ORDER BY k) OR k <> lag(k) OVER (ORDER BY k) + 1)::INT AS fresh FROM p WHERE c IS NOT NULL)),
   j AS (SELECT *, row_number() OVER (PARTITION BY island ORDER BY k) - 1 AS nth FROM i),
   o AS (SELECT j.*, coalesce(l.c > j.c, true) AND coalesce(lc.c > j.c, true) AND coalesce(r.c >= j.c, true) AND coalesce(rc.c > j.c, true) AS sure
     FROM (SELECT *, (CASE WHEN nth = 0 THEN before ELSE c END)::BIGINT * {PAIR} AS behind FROM j WHERE nth % 2 = 0) j
     LEFT JOIN lefts l ON l.pair = behind + id LEFT JOIN lefts lc ON lc.pair = behind + j.c
     LEFT JOIN rights r ON r.pair = after::BIGINT * {PAIR} + beyond LEFT JOIN rights rc ON rc.pair = j.c::BIGINT * {PAIR} + beyond),
   x AS (SELECT k, c FROM (SELECT k, c, nth, sure, least, bool_and(sure) OVER (PARTITION BY island) AS whole FROM o)
     WHERE whole OR nth = 0 AND sure OR k % {PLACES} = least % {PLACES}),
   y AS (SELECT p.k, word, id, round, x.c AS made, lag(x.c) OVER (PARTITION BY word ORDER BY p.k) AS taken, least FROM p LEFT JOIN x ON x.k = p.k)
   SELECT word * {PLACES} + row_number() OVER (PARTITION BY word ORDER BY k) - 1, coalesce(made, id), least IS NOT NULL, round + 1 FROM y WHERE taken IS NULL))
SELECT k // {PLACES} AS word, list(id ORDER BY k) AS ids, any_value(live) AS live FROM s WHERE NOT live OR round = {CALL_ROUNDS} GROUP BY ALL ORDER BY word
"""

DECODED = """
SELECT stretch, list(piece ORDER BY place) AS pieces
FROM (SELECT stretch, unnest(ids) AS id, generate_subscripts(ids, 1) AS place FROM wanted) JOIN vocabulary USING (id) GROUP BY stretch ORDER BY stretch
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Ranks(Encoder):
    """Encodes and decodes by one rank file. Every byte must be a token of its own."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        ranks = read_ranks(path)
        self.words, self.specials, self.classes = False, [], _classes()
        self.memo, self.back, self.pattern = Memo(np.uint32), Memo(np.uint8), regex.compile(pattern)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.inside = np.zeros((256, 256), bool)
        for t in ranks:
            self.inside[list(t[:-1]), list(t[1:])] = True
        self.blank = np.zeros(max(ranks.values()) + 1, bool)
        self.blank[[r for t, r in ranks.items() if t[:1] in b" \n"]] = True
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        vocabulary = pa.table({"id": pa.array(ranks.values(), pa.int32()), "piece": pa.array(ranks, pa.binary())})
        halves = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        split = pa.table(dict(zip(("a", "b", "c"), map(lambda x: pa.array(x, pa.int32()), zip(*halves, strict=True)), strict=True)))
        # Tokens that end, or begin, with a token.
        ends = pa.table(dict(zip(("a", "tail"), map(lambda x: pa.array(x, pa.int32()), zip(*[(r, ranks[t[i:]]) for t, r in ranks.items() for i in range(len(t)) if t[i:] in ranks], strict=True)), strict=True)))
        heads = pa.table(dict(zip(("b", "head"), map(lambda x: pa.array(x, pa.int32()), zip(*[(r, ranks[t[:i]]) for t, r in ranks.items() for i in range(1, len(t) + 1) if t[:i] in ranks], strict=True)), strict=True)))
        for name, table in (("vocabulary_", vocabulary), ("split", split), ("ends", ends), ("heads", heads)):
            self.db.register(name, table)
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_")
        self.db.execute(f"CREATE TABLE merges AS SELECT a::BIGINT * {PAIR} + b AS pair, c FROM split")
        self.db.execute(f"CREATE TABLE lefts AS SELECT tail::BIGINT * {PAIR} + b AS pair, min(c) AS c FROM split JOIN ends USING (a) GROUP BY ALL")
        self.db.execute(f"CREATE TABLE rights AS SELECT a::BIGINT * {PAIR} + head AS pair, min(c) AS c FROM split JOIN heads USING (b) GROUP BY ALL")
        for name in ("vocabulary_", "split", "ends", "heads"):
            self.db.unregister(name)

    @staticmethod
    def at(path: str, pattern: str) -> Ranks:
        cache = worker_cache()
        if ("ranks", path, pattern) not in cache:
            cache["ranks", path, pattern] = Ranks(path, pattern)
        return cache["ranks", path, pattern]

    def library(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The strings' ids in a row and the number of each."""
        found = [self.pattern.findall(s) for s in strings]
        at = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        ids, size = self.contracted([w.encode("utf-8", "surrogatepass") for w in at])
        bounds = np.concatenate([[0], np.cumsum(size)])
        which = np.fromiter((at[w] for ws in found for w in ws), np.int64, sum(map(len, found)))
        n = size[which]
        into = np.concatenate([[0], np.cumsum(n)])
        flat = ids[np.repeat(bounds[which] - into[:-1], n) + np.arange(into[-1])]
        ends = into[np.cumsum([0, *map(len, found)])]
        return flat, np.diff(ends)

    def contracted(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and the number of each."""
        flat = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        if not len(flat):
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        cut = np.ones(len(flat) + 1, bool)
        cut[1:-1] = ~self.inside[flat[:-1], flat[1:]]
        cut[ends] = True
        start = np.flatnonzero(cut)
        size = np.diff(start)
        parts: list[np.ndarray | None] = [None] * len(size)
        for long in (False, True):
            some = np.flatnonzero((size > SHORT) == long)
            edge = np.flatnonzero(np.diff(np.cumsum(size[some]) // CALL_BYTES, prepend=0)) if len(some) else []
            for group in np.split(some, edge):
                if len(group):
                    ids = [self.byte[flat[a : a + n]] for a, n in zip(start[group].tolist(), size[group].tolist(), strict=True)] if long else None
                    got = self._long(ids) if long else self._short(flat, start[group], size[group])
                    for i, x in zip(group.tolist(), got, strict=True):
                        parts[i] = x
        n = np.fromiter(map(len, parts), np.int64, len(parts))
        out = np.concatenate(parts).astype(np.uint32)
        total = np.concatenate([[0], np.cumsum(n)])
        at = total[np.searchsorted(start[:-1], np.concatenate([[0], ends]))]
        return out, np.diff(at)

    def _begun(self, ids: np.ndarray, size: np.ndarray) -> pa.Table:
        place = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
        return pa.table({"k": np.repeat(np.arange(len(size)), size) * PLACES + place, "id": ids})

    def _short(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        which = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return _lists(self._asked(SHORT_ROUNDS, "begun", self._begun(self.byte[flat[which]], size)), "ids")

    def _long(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """CALL_ROUNDS rounds a query, which bounds what a query holds, until all are whole."""
        out, left = list(ids), np.arange(len(ids))
        while len(left):
            now = [out[i] for i in left]
            got = self._asked(LONG_ROUNDS, "begun", self._begun(np.concatenate(now), np.array(list(map(len, now)))))
            for i, x in zip(left.tolist(), _lists(got, "ids"), strict=True):
                out[i] = x
            left = left[got["live"].to_numpy()]
        return out

    def _asked(self, query: str, name: str, table: pa.Table) -> pa.Table:
        self.db.register(name, table)
        try:
            return self.db.sql(query).to_arrow_table()
        finally:
            self.db.unregister(name)

    def decoded(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all documents in a row and the n + 1 bounds."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(bounds), np.int64)
        known = ids < len(self.blank)
        edge = self.blank[np.where(known, ids, 0)] & known
        edge[bounds[:-1][bounds[:-1] < len(ids)]] = True
        begin = np.flatnonzero(edge)
        end = np.append(begin[1:], len(ids))
        make = lambda new: self._pieces(ids, begin[new], end[new])
        got = self.back.of(np.ascontiguousarray(ids.astype("<u4")).view(np.uint8), 4 * begin, 4 * end, make)
        if got is None:
            flat, size = self._pieces(ids, begin, end)
            got = flat, np.concatenate([[0], np.cumsum(size)])
        flat, total = got
        return flat, total[np.searchsorted(begin, bounds)]

    def _pieces(self, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = end - begin
        which = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids[which].astype(np.int32)))
        got = self._asked(DECODED, "wanted", pa.table({"stretch": np.arange(len(size)), "ids": lists}))
        pieces = got["pieces"].combine_chunks()
        if len(pieces) != len(size) or len(pieces.values) != len(which):
            raise ValueError("an id is not in the vocabulary")
        offsets = np.frombuffer(pieces.values.buffers()[1], np.int32, len(pieces.values) + 1, pieces.values.offset * 4).astype(np.int64)
        bounds = offsets[pieces.offsets.to_numpy()]
        return np.frombuffer(pieces.values.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], np.diff(bounds)


def _lists(table: pa.Table, column: str) -> list[np.ndarray]:
    x = table[column].combine_chunks()
    flat, at = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encode(docs: DataFrame, ranks: str, pattern: str | None = None, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the ids (array<int>) of every whole text, by a rank file; pattern splits texts into words. decoded: also the bytes that the ids give back."""
    tune(docs.sparkSession)
    pattern = pattern or _pattern()

    def run(batches):
        r = Ranks.at(ranks, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                some = batch.slice(k, TEXTS)
                ids, bounds = r.batch(some.column(1))
                columns = {"doc_id": some.column(0), "ids": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32)))}
                yield pa.record_batch(columns | ({"decoded": _binary(*r.decoded(ids, bounds))} if decoded else {}))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(trimmed(run), "doc_id long, ids array<int>" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: str, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and the bytes that the ids stand for (decoded). Null ids decode to nothing; an id that is not in the vocabulary is an error."""
    tune(encoded.sparkSession)
    pattern = pattern or _pattern()

    def run(batches):
        r = Ranks.at(ranks, pattern)
        for batch in batches:
            for k in range(0, batch.num_rows, TEXTS):
                some = batch.slice(k, TEXTS)
                lists = some.column(1)
                bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                yield pa.record_batch({"doc_id": some.column(0), "ids": lists, "decoded": _binary(*r.decoded(lists.flatten().to_numpy(zero_copy_only=False), bounds))})

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(run), "doc_id long, ids array<int>, decoded binary")


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    whole = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])
    return whole.cast(pa.binary())


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN
