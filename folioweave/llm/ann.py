"""Approximate nearest neighbours: a neighbour graph by NN-descent, queries by greedy search in it.

Equal vectors are one node, for which its smallest id stands; of each node at
most as many smallest ids are kept as a query can ask for, so any number of
copies is exact. The graph starts from the nearest nodes in two random blocks.
Each round of NN-descent joins every node's neighbours and (a sample of) those
that have it as a neighbour with their vectors, compares them with each other,
and gives each the nearer ones it learns of; rounds end when the graph has
converged: hardly a list entry changes, however many rounds that takes. Nodes are
dealt into blocks, a task each: a vector that several nodes of a block need goes
there once, and what travels between two blocks is one row.

Queries are rows of the table, so each starts from its own node's list. All
queries search at once: the nearest nodes that were not expanded meet the graph
and the vectors, round by round, until the `width` nearest known are expanded;
queries come to the blocks of vectors, only nearer nodes go back to them.
A sample of the queries is also answered by brute force. While the search finds
too few of its true neighbours, the width doubles for all queries and the search
goes on, up to WIDEST times the first width, which bounds what a query holds; where
that still finds too few, blocks of queries meet blocks of vectors in one exact pass.
The last ranking takes exact distances of the original vectors, in double.

Graph and search see the vectors scaled by one power of two, so that the largest
component is about 1: as 32-bit numbers where the longest components of all
vectors lie within 2**40 of each other, else as 64-bit ones, so no square
overflows or vanishes.

Defined results: vectors that are null, zero, of another length than most or
hold null or non-finite components take no part, as queries or candidates; ties
go to the smaller id; rows that repeat an id are one row, with the least of their
vectors that take part (by the first component that differs); fewer candidates
than asked for are all returned; null ids take no part; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import stage, tune

DEGREE, REVERSE, BLOCK, ENOUGH = 28, 20, 2048, 0.001
#: The width to begin with.
WIDTH, STEP = 420, 70
#: Times the first width that a search may widen to.
WIDEST = 32
#: Recall that the sample of queries must reach, with two standard errors to spare.
TARGET, SAMPLE = 0.9, 256
#: Queries, and vectors, of one block of the exact pass.
CHUNK = 2048
LISTS = "u long, ws array<long>, ds array<double>, new array<boolean>"
#: Bytes of vectors, and nodes, that one block of nodes has in memory at most.
HELD, MOST = 128 << 20, 65536
#: What travels between blocks of nodes: a row is all that one task sends to one block, of one kind.
PACK = "block int, kind int, dest int, a array<long>, b array<long>, d array<double>, new array<boolean>, vecs binary"
NODES, FORWARD, BACK, FARS, MEMBERS, ASKED, VECTORS, ENTRIES, EXPAND, PAIRS, QUERIES = range(11)
#: Pairs that a task gathers before it sends them on.
GATHERED = 1 << 19
#: Powers of two between the longest components of vectors that 32-bit numbers may hold.
SPREAD = 40


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    good = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False)))
    # Of an id's vectors the least one, whatever the order of the rows.
    rows = vectors.where(good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _rows(parts: list[bytes], dim: int) -> np.ndarray:
    """Vectors from their bytes, which are of 32-bit or of 64-bit numbers."""
    return np.frombuffer(b"".join(parts), np.float32 if not parts or len(parts[0]) == 4 * dim else np.float64).reshape(-1, dim)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return _rows(column.to_pylist(), dim)


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    first = np.zeros(len(sorted_keys[0]), bool)
    first[:1] = True
    for key in sorted_keys:
        first[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(first)


def _joint(a: np.ndarray, b: np.ndarray):
    """One number for each pair, in the order of pairs, and what gives the pairs back: one sort of numbers is several times as fast as one by two keys."""
    if not len(a) or (min(a.min(), b.min()) >= 0 and (int(a.max()) + 1) * (int(b.max()) + 1) < 1 << 63):
        n = int(b.max(initial=0)) + 1
        return a * n + b, lambda key: (key // n, key % n)
    (ta, ia), (tb, ib) = (np.unique(c, return_inverse=True) for c in (a, b))
    return ia * len(tb) + ib, lambda key: (ta[key // len(tb)], tb[key % len(tb)])


def _top(u: np.ndarray, w: np.ndarray, d: np.ndarray, new: np.ndarray, k: int):
    """Of each u the k nearest distinct w; an entry that was there before stays not new."""
    if not len(u):
        return u, w, d, new
    key, pairs = _joint(u, w)
    order = np.argsort(key)
    key = key[order]
    # An old entry and a new one of the same pair may differ in the last bits: the pair is old if any is.
    first = _starts(key)
    new, d = np.logical_and.reduceat(new[order], first), np.minimum.reduceat(d[order], first)
    u, w = pairs(key[first])
    start = _starts(u)
    size = np.diff(np.append(start, len(u)))
    # Pairs are in order, so stable sorts leave equally near ones by w; of 16 bits they take no comparisons.
    order = np.argsort(d, kind="stable")
    rank = np.repeat(np.arange(len(start), dtype=np.uint16 if len(start) <= 1 << 16 else np.int64), size)
    order = order[np.argsort(rank[order], kind="stable")]
    order = order[np.arange(len(u)) - np.repeat(start, size) < k]
    return u[order], w[order], d[order], new[order]


def _lists(u, w, d, new) -> pa.RecordBatch:
    start = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]])) if len(u) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(start, len(u)).astype(np.int32))
    wrap = lambda x, t: pa.ListArray.from_arrays(offsets, pa.array(x, t))
    return pa.record_batch([pa.array(u[start], pa.int64()), wrap(w, pa.int64()), wrap(d.astype(np.float64), pa.float64()), wrap(new, pa.bool_())], ["u", "ws", "ds", "new"])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances. 32-bit vectors are moved to the first one to keep digits; those of 64 bits may differ too much in length for that."""
    if a.dtype == np.float64:
        return np.stack([((b - x) ** 2).sum(1) for x in a])
    at = a[:1]
    a, b = a - at, b - at
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def _in_block(dim: int, k: int):
    """Rows (u, vec) of one partition, in blocks of BLOCK: each one's k nearest there."""

    def block(ids, x):
        for a in range(0, len(ids), 512):
            d = _squared(x[a : a + 512], x)
            d[np.arange(len(d)), a + np.arange(len(d))] = np.inf
            m = min(k, len(ids) - 1)
            if m < 1:
                return
            at = np.argpartition(d, m - 1, 1)[:, :m]
            u = np.repeat(ids[a : a + 512], m)
            yield _lists(*_top(u, ids[at].ravel(), np.take_along_axis(d, at, 1).ravel(), np.ones(len(u), bool), m))

    def run(batches):
        ids, x = np.zeros(0, np.int64), np.zeros((0, dim), np.float32)
        for batch in batches:
            ids, x = np.concatenate([ids, batch.column(0).to_numpy()]), np.concatenate([x, _matrix(batch.column(1), dim)]) if len(x) else _matrix(batch.column(1), dim)
            while len(ids) >= 2 * BLOCK:
                yield from block(ids[:BLOCK], x[:BLOCK])
                ids, x = ids[BLOCK:], x[BLOCK:]
        if len(ids):
            yield from block(ids, x)

    return run


def _home(u: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a node; two moduli, so that no step between ids sends them all to one."""
    return ((np.mod(u, 2147483647) * 1103515245 + np.mod(u, 2147483629) * 1664525) >> 15) % blocks


def _pack(kind: int, block: np.ndarray, a: np.ndarray, b=None, d=None, new=None, x=None, dest: int = 0):
    """A batch with one row for each block that something goes to; none, if nothing does."""
    if not len(a):
        return
    order = np.argsort(block, kind="stable")
    start = _starts(block[order])
    ends = np.append(start, len(a))
    lists = lambda c, t: pa.nulls(len(start), pa.list_(t)) if c is None else pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(c[order], t))
    vecs = pa.nulls(len(start), pa.binary()) if x is None else pa.array([x[order[i:j]].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)], pa.binary())
    one = lambda v: pa.array(np.full(len(start), v), pa.int32())
    yield pa.record_batch(
        [pa.array(block[order][start], pa.int32()), one(kind), one(dest), lists(a, pa.int64()), lists(b, pa.int64()), lists(d, pa.float64()), lists(new, pa.bool_()), vecs],
        ["block", "kind", "dest", "a", "b", "d", "new", "vecs"],
    )


def _unpacked(batches) -> tuple[int, dict]:
    """The block of a task, and its rows by kind."""
    block, held = 0, {k: [] for k in range(11)}
    for batch in batches:
        if batch.num_rows:
            kinds, block = batch.column(1).to_numpy(), batch.column(0)[0].as_py()
            for kind in np.unique(kinds).tolist():
                held[kind].append(batch.filter(pa.array(kinds == kind)))
    return block, held


def _flat(rows: list, *names: str) -> list[np.ndarray]:
    kinds = {"a": np.int64, "b": np.int64, "d": np.float64, "new": bool}
    return [np.concatenate([np.zeros(0, kinds[c]), *(r[c].flatten().to_numpy(zero_copy_only=False) for r in rows)]).astype(kinds[c], copy=False) for c in names]


def _held_vectors(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted ids of rows with vectors, each vector once in memory, and where each id's is."""
    (ids,) = _flat(rows, "a")
    x, at = None, 0
    for batch in rows:
        for one in batch["vecs"]:
            raw = np.frombuffer(one.as_buffer(), np.uint8)
            if x is None:
                x = np.empty((len(ids), dim), np.float32 if len(raw) == 4 * dim * len(batch["a"][0]) else np.float64)
            n = len(raw) // (dim * x.itemsize)
            x[at : at + n], at = raw.view(x.dtype).reshape(n, dim), at + n
        del one
    return ids, np.zeros((0, dim), np.float32) if x is None else x


def _places(ids: np.ndarray):
    """A function from ids to their places; all must be there."""
    order = np.argsort(ids)
    there = ids[order]
    return lambda u: order[np.searchsorted(there, u)]


def _entries(batches):
    """u, w, d, new of whole lists, GATHERED and a batch at most at a time."""
    held, n = [], 0
    for batch in batches:
        ws = batch.column(1)
        size = ws.value_lengths().to_numpy(zero_copy_only=False)
        held.append((np.repeat(batch.column(0).to_numpy(), size), ws.flatten().to_numpy(), batch.column(2).flatten().to_numpy(), batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(bool)))
        n += len(held[-1][0])
        if n >= GATHERED:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, n = [], 0
    if n:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _send_nodes(dim: int, blocks: int):
    """Nodes (u, vec) to their blocks."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 4 * BLOCK:
                yield from send(held)
                held, n = [], 0
        if n:
            yield from send(held)

    def send(held):
        u = np.concatenate([b.column(0).to_numpy() for b in held])
        return _pack(NODES, _home(u, blocks), u, x=np.concatenate([_matrix(b.column(1), dim) for b in held]))

    return run


def _send_neighbours(blocks: int):
    """Each list to its node's block, and each node to those of its neighbours."""

    def run(batches):
        for u, w, _, new in _entries(batches):
            yield from _pack(FORWARD, _home(u, blocks), u, w, new=new)
            yield from _pack(BACK, _home(w, blocks), w, u, new=new)

    return run


def _send_lists(blocks: int, fresh: bool = False):
    """Each list to its node's block: as entries to merge, which were there before unless fresh."""

    def run(batches):
        for u, w, d, new in _entries(batches):
            yield from _pack(ENTRIES, _home(u, blocks), u, w, d, new & fresh)

    return run


def _send_fars(blocks: int, degree: int):
    """How far the last of a full list is."""

    def run(batches):
        for u, _, d, _ in _entries(batches):
            start = _starts(u)
            size = np.diff(np.append(start, len(u)))
            far = np.where(size >= degree, np.maximum.reduceat(d, start), np.inf)
            yield from _pack(FARS, _home(u[start], blocks), u[start], d=far)

    return run


def _members(blocks: int, turn: int):
    """Of each node v of a block the neighbours u and REVERSE of those that have it as one, where any is new; and which vectors that block needs, each once."""

    def run(batches):
        block, held = _unpacked(batches)
        v, u, new = _flat(held[FORWARD], "a", "b", "new")
        to, by, late = _flat(held[BACK], "a", "b", "new")
        # The sample of reverse neighbours bounds what one node compares; new ones come first.
        chance = (np.mod(by, 2147483647) * 1103515245 + turn * 12345678 >> 7) * 2654435761 % 4294967291
        order = np.argsort(np.unique(to, return_inverse=True)[1] << 33 | ~late * (1 << 32) | chance)
        to, by, late = to[order], by[order], late[order]
        start = _starts(to)
        keep = np.arange(len(to)) - np.repeat(start, np.diff(np.append(start, len(to)))) < REVERSE
        v, u, new = np.concatenate([v, to[keep]]), np.concatenate([u, by[keep]]), np.concatenate([new, late[keep]])
        if not len(v):
            return
        key, pairs = _joint(v, u)
        order = np.argsort(key)
        first = _starts(key[order])
        new = np.logical_or.reduceat(new[order], first)
        v, u = pairs(key[order][first])
        start = _starts(v)
        keep = np.repeat(np.logical_or.reduceat(new, start), np.diff(np.append(start, len(v))))
        v, u, new = v[keep], u[keep], new[keep]
        need = np.unique(u)
        yield from _pack(ASKED, _home(need, blocks), need, dest=block)
        for a in range(0, len(v), GATHERED):
            some = slice(a, a + GATHERED)
            yield from _pack(MEMBERS, np.full(len(v[some]), block), v[some], u[some], new=new[some])

    return run


def _fetch(dim: int):
    """A block's vectors, with how far its nodes' lists reach, to the blocks that asked for them."""

    def run(batches):
        _, held = _unpacked(batches)
        ids, x = _held_vectors(held[NODES], dim)
        place, far = _places(ids), np.full(len(ids), np.inf)
        u, d = _flat(held[FARS], "a", "d")
        far[place(u)] = d
        for rows in held[ASKED]:
            for dest, asked in zip(rows["dest"].to_pylist(), rows["a"], strict=True):
                asked = asked.values.to_numpy()
                for a in range(0, len(asked), 4 * BLOCK):
                    some = asked[a : a + 4 * BLOCK]
                    at = place(some)
                    yield from _pack(VECTORS, np.full(len(some), dest), some, d=far[at], x=x[at])

    return run


def _compare(dim: int, best: int, blocks: int):
    """For each member u of a node the nearest others of that node, if nearer than u's list reaches; to the block of u."""

    def near(x, far, at, new, size):
        """The places (i, j) and squared distances of pairs of members of the nodes with these members, one row of at (padded) each."""
        y = x[at]
        if x.dtype == np.float64:
            d = np.stack([((y - y[:, i : i + 1]) ** 2).sum(2) for i in range(y.shape[1])], 1)
        else:
            y -= y[:, :1].copy()
            square = np.einsum("nij,nij->ni", y, y)
            d = np.maximum(square[:, :, None] + square[:, None] - 2 * np.matmul(y, y.transpose(0, 2, 1)), 0)
        inside = np.arange(at.shape[1]) < size[:, None]
        ok = (d < far[at][:, :, None]) & (new[:, :, None] | new[:, None]) & inside[:, :, None] & inside[:, None]
        i = np.arange(at.shape[1])
        ok[:, i, i] = False
        many = ok.sum(2) > best
        if many.any():
            rows = np.where(ok[many], d[many], np.inf)
            kept = np.zeros(rows.shape, bool)
            np.put_along_axis(kept, np.argpartition(rows, best - 1, 1)[:, :best], True, 1)
            ok[many] &= kept
        n, i, j = np.nonzero(ok)
        return at[n, i], at[n, j], d[n, i, j]

    def run(batches):
        _, held = _unpacked(batches)
        ids, x = _held_vectors(held[VECTORS], dim)
        (far,) = _flat(held.pop(VECTORS), "d")
        v, u, new = _flat(held.pop(MEMBERS), "a", "b", "new")
        order = np.argsort(v, kind="stable")
        v, at, new = v[order], _places(ids)(u[order]), new[order]
        start = _starts(v)
        size = np.diff(np.append(start, len(v)))
        # Nodes of about as many members together.
        turn = np.argsort(size, kind="stable")
        start, size = start[turn], size[turn]
        found, n = [], 0

        def learned():
            i, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
            one, other, d, _ = _top(i, j, d, np.ones(len(i), bool), DEGREE)
            return _pack(ENTRIES, _home(ids[one], blocks), ids[one], ids[other], d, np.ones(len(one), bool))

        many = max(1, (1 << 20) // (dim * x.itemsize * int(size.max(initial=1))))
        for a in range(0, len(start), many):
            some, most = size[a : a + many], int(size[a : a + many].max())
            place = np.minimum(start[a : a + many, None] + np.arange(most), len(v) - 1)
            found.append(near(x, far, at[place], new[place], some))
            n += len(found[-1][0])
            if n >= 2 * GATHERED:
                yield from learned()
                found, n = [], 0
        if n:
            yield from learned()

    return run


def _merge(k: int):
    """Entries of a block's lists: one list of the k nearest for each node, GATHERED times eight at a time beside the lists."""

    def run(batches):
        held, n, least = [], 0, 8 * GATHERED
        for batch in batches:
            held.append(_flat([batch], "a", "b", "d", "new"))
            n += len(held[-1][0])
            if n >= least:
                held = [_top(*(np.concatenate(c) for c in zip(*held, strict=True)), k)]
                n = len(held[0][0])
                least = n + 8 * GATHERED
        if not n:
            return
        u, w, d, new = _top(*(np.concatenate(c) for c in zip(*held, strict=True)), k)
        ends = np.append(_starts(u), len(u))
        for a in range(0, len(ends) - 1, 2 * BLOCK):
            some = slice(ends[a], ends[min(a + 2 * BLOCK, len(ends) - 1)])
            yield _lists(u[some], w[some], d[some], new[some])

    return run


def _packs(df: DataFrame, run) -> DataFrame:
    return df.mapInArrow(run, PACK)


def _dealt(blocks: int, *packs: DataFrame) -> DataFrame:
    """Each block one partition."""
    return reduce(DataFrame.unionByName, packs).repartitionById(blocks, F.col("block"))


def block_count(nodes: DataFrame, count: int, size: int, degree: int) -> int:
    """As few blocks of nodes as keep all cores at work and what one needs, its own nodes and the vectors of all their members, in bounds: a vector that several nodes of a block need goes there once."""
    least = max(6, nodes.sparkSession.sparkContext.defaultParallelism, -(-count // MOST))
    fit, reach = HELD // size, degree + REVERSE
    return least if count <= fit else max(least, int(np.ceil(reach / -np.log1p(-fit / count))))


def neighbour_graph(nodes: DataFrame, count: int, dim: int, degree: int = DEGREE):
    """Lists (u, ws, ds, new) of near nodes. nodes: u, vec (float32 or float64 bytes)."""
    blocks = block_count(nodes, count, 8 * dim if count and len(nodes.first()["vec"]) == 8 * dim else 4 * dim, degree)
    begin = None
    for seed in ("a", "b"):
        lists = nodes.repartition(max(1, -(-count // BLOCK)), F.xxhash64("u", F.lit(seed))).sortWithinPartitions("u").mapInArrow(_in_block(dim, degree // 2), LISTS)
        begin = lists if begin is None else begin.unionByName(lists)
    there = stage(_packs(nodes, _send_nodes(dim, blocks)), "graph-nodes")
    graph = stage(_dealt(blocks, _packs(begin, _send_lists(blocks, True))).mapInArrow(_merge(degree), LISTS), "graph-0")
    turn, changed = 0, count * degree
    # Lists only get nearer, so the changes come to an end.
    while changed > ENOUGH * degree * count:
        turn += 1
        members = stage(_packs(_dealt(blocks, _packs(graph.df, _send_neighbours(blocks))), _members(blocks, turn)), "members")
        asked, wanted = (members.df.where(F.col("kind") == k) for k in (ASKED, MEMBERS))
        vectors = _packs(_dealt(blocks, there.df, _packs(graph.df, _send_fars(blocks, degree)), asked), _fetch(dim))
        learned = _packs(_dealt(blocks, vectors, wanted), _compare(dim, 8, blocks))
        following = stage(_dealt(blocks, learned, _packs(graph.df, _send_lists(blocks))).mapInArrow(_merge(degree), LISTS), f"graph-{turn}")
        members.drop()
        graph.drop()
        graph = following
        changed = graph.df.agg(F.sum(F.size(F.filter("new", lambda x: x)))).first()[0] or 0
    there.drop()
    return graph


def _send_expanded(blocks: int):
    """Rows (q, expand): each node to expand, with its query, to the node's block."""

    def run(batches):
        for batch in batches:
            us = batch.column(1)
            u, q = us.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), us.value_lengths().to_numpy(zero_copy_only=False))
            yield from _pack(EXPAND, _home(u, blocks), u, q)

    return run


def _send_queries(blocks: int):
    """Rows (q, qvec, far): the queries to each block."""

    def run(batches):
        for batch in batches:
            q, n = batch.column(0).to_numpy(), batch.num_rows
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)
            for block in range(blocks):
                yield from _pack(QUERIES, np.full(n, block), q, d=batch.column(2).to_numpy(), x=x)

    return run


def _follow(blocks: int):
    """The neighbours of the nodes that queries expand, to their own blocks."""

    def run(batches):
        _, held = _unpacked(batches)
        at, to = _flat(held[ENTRIES], "a", "b")
        order = np.argsort(at, kind="stable")
        at, to = at[order], to[order]
        u, q = _flat(held[EXPAND], "a", "b")
        low = np.searchsorted(at, u)
        size = np.searchsorted(at, u, "right") - low
        ends = np.cumsum(size)
        a = 0
        while a < len(u):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 2 * GATHERED)))
            n = size[a:b]
            w = to[np.repeat(low[a:b] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            key, pairs = _joint(w, np.repeat(q[a:b], n))
            w, by = pairs(np.unique(key))
            yield from _pack(PAIRS, _home(w, blocks), w, by)
            a = b

    return run


FOUND = "q long, kind int, qvec binary, ids array<long>, ds array<double>, done array<boolean>"


def _measure(dim: int):
    """Where the vectors are: for each query the nodes it came to that are nearer than the last of its list."""

    def run(batches):
        _, held = _unpacked(batches)
        ids, x = _held_vectors(held.pop(NODES), dim)
        asked, y = _held_vectors(held[QUERIES], dim)
        (far,) = _flat(held[QUERIES], "d")
        w, q = _flat(held.pop(PAIRS), "a", "b")
        if not len(w):
            return
        key, pairs = _joint(q, w)
        q, w = pairs(np.unique(key))
        left, right = _places(asked)(q), _places(ids)(w)
        some = max(1, (1 << 20) // (dim * x.itemsize))
        d = np.concatenate([((x[right[a : a + some]] - y[left[a : a + some]]) ** 2).sum(1) for a in range(0, len(q), some)])
        near = d < far[left]
        q, w, d = q[near], w[near], d[near].astype(float)
        ends = np.append(_starts(q), len(q))
        for a in range(0, len(ends) - 1, 200):
            at = ends[a : a + 201]
            n, part = len(at) - 1, slice(at[0], at[-1])
            lists = lambda c, t: pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(c, t))  # noqa: B023, E731
            yield pa.record_batch([pa.array(q[at[:-1]]), pa.array(np.ones(n), pa.int32()), pa.nulls(n, pa.binary()), lists(w[part], pa.int64()), lists(d[part], pa.float64()), pa.nulls(n, pa.list_(pa.bool_()))], ["q", "kind", "qvec", "ids", "ds", "done"])

    return run


def _update(width: int, step: int):
    """Rows (q, kind 0 state: qvec, ids, ds, done; kind 1 what was found: ids, ds) sorted by q, kind: the next states, with what to expand."""
    kinds = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.bool_()), pa.list_(pa.int64())]

    def state(q, qvec, ids, ds, done, fresh, rows):
        if fresh:
            w, d = (np.concatenate(c) for c in zip(*fresh, strict=True))
            w, first = np.unique(w, return_index=True)
            unseen = ~np.isin(w, ids)
            w, d = w[unseen], d[first[unseen]]
            ids, ds, done = np.concatenate([ids, w]), np.concatenate([ds, d]), np.concatenate([done, np.zeros(len(w), bool)])
        order = np.lexsort((ids, ds))[:width]
        ids, ds, done = ids[order], ds[order], done[order]
        expand = np.flatnonzero(~done)[:step]
        done[expand] = True
        rows.append((q, qvec, ids, ds, done, ids[expand]))

    def run(batches):
        now, fresh, rows = None, [], []
        for batch in batches:
            for i, (q, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                ids, ds = (batch.column(c)[i].values.to_numpy() for c in (3, 4))
                if now is None or q != now[0]:
                    if now:
                        state(*now, fresh, rows)
                    now, fresh = (q, batch.column(2)[i].as_py(), ids, ds, batch.column(5)[i].values.to_numpy(zero_copy_only=False).astype(bool)), []
                if kind:
                    fresh.append((ids, ds))
            if len(rows) >= 200:
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["q", "qvec", "ids", "ds", "done", "expand"])
                rows = []
        if now:
            state(*now, fresh, rows)
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["q", "qvec", "ids", "ds", "done", "expand"])

    return run


def brute_force(nodes: DataFrame, asked: list, dim: int, k: int) -> DataFrame:
    """q, u, d: the k nearest other nodes of each of the few asked rows (q, qvec), with squared distances."""
    ids = np.array([r["q"] for r in asked], np.int64)
    x = _rows([bytes(r["qvec"]) for r in asked], dim)

    def run(batches):
        us, ds = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for batch in batches:
            u, y = batch.column(0).to_numpy(), _matrix(batch.column(1), dim)
            d = np.stack([((y - q) ** 2).sum(1) for q in x])
            d[ids[:, None] == u[None]] = np.inf
            if ds.shape[1] >= k:
                # Only nodes that some query may keep are sorted.
                some = (d <= ds[:, k - 1 : k]).any(0)
                u, d = u[some], d[:, some]
            us, ds = np.concatenate([us, np.broadcast_to(u, d.shape)], 1), np.concatenate([ds, d], 1)
            order = np.lexsort((us, ds), axis=1)[:, :k]
            us, ds = np.take_along_axis(us, order, 1), np.take_along_axis(ds, order, 1)
        i, j = np.nonzero(ds < np.inf)
        yield pa.record_batch([pa.array(ids[i]), pa.array(us[i, j]), pa.array(ds[i, j], pa.float64())], ["q", "u", "d"])

    near = nodes.select("u", "vec").mapInArrow(run, "q long, u long, d double")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "u"))).where(F.col("r") <= k).drop("r")


def exact(nodes: DataFrame, asked: DataFrame, n_nodes: int, n_asked: int, dim: int, k: int) -> DataFrame:
    """q, u: the k nearest other nodes of each asked node (q, qvec). Each block of queries meets each block of vectors in one task, which hands on k of each query; a vector is copied once for each block of queries."""
    left, right = -(-n_asked // CHUNK), -(-n_nodes // CHUNK)
    own = lambda c, n: F.pmod(F.xxhash64(c, F.lit("block")), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.select(own("q", left).alias("x"), every(right).alias("y"), "q", "qvec")
    b = nodes.select(every(left).alias("x"), own("u", right).alias("y"), "u", "vec")

    def product(qs: pa.Table, us: pa.Table) -> pa.Table:
        ids, u = qs["q"].to_numpy(), us["u"].to_numpy()
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(u):
            x, y = _rows(qs["qvec"].to_pylist(), dim), _rows(us["vec"].to_pylist(), dim)
            for i, one in enumerate(x):
                d = ((y - one) ** 2).sum(1).astype(float)
                d[u == ids[i]] = np.inf
                order = np.lexsort((u, d))[:k]
                order = order[d[order] < np.inf]
                out.append((np.full(len(order), ids[i]), u[order], d[order]))
        q, w, d = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.table({"q": q, "u": w, "d": d})

    near = a.groupBy("x", "y").cogroup(b.groupBy("x", "y")).applyInArrow(product, "q long, u long, d double")
    return near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "u"))).where(F.col("r") <= k).select("q", "u")


def recalls(nodes: DataFrame, states: DataFrame, dim: int, k: int, sample: int) -> np.ndarray:
    """Of each of a sample of queries the share of its k nearest nodes that its state holds; equally near ones count alike."""
    rows = states.orderBy(F.xxhash64("q"), "q").limit(sample).select("q", "qvec", F.slice("ids", 1, k + 1).alias("ids"), F.slice("ds", 1, k + 1).alias("ds")).collect()
    true: dict[int, list[float]] = {}
    for r in brute_force(nodes, rows, dim, k).select("q", "d").collect():
        true.setdefault(r["q"], []).append(r["d"])
    out = []
    for r in rows:
        want = true.get(r["q"], [])
        hits = sum(d <= max(want) * (1 + 1e-5) for i, d in zip(r["ids"], r["ds"], strict=True) if i != r["q"]) if want else 0
        out.append(min(hits, len(want)) / len(want) if want else 1.0)
    return np.array(out)


def _vec(exponent: int, kind):
    """array<double> to bytes of numbers of a kind, scaled by 2**-exponent."""

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            dim = len(lists[0]) if len(lists) else 1
            flat = np.ldexp(lists.flatten().to_numpy(zero_copy_only=False), -exponent).astype(kind)
            size, raw = dim * flat.itemsize, flat.tobytes()
            yield pa.record_batch([batch.column(0), pa.array([raw[size * i : size * (i + 1)] for i in range(len(lists))], pa.binary())], ["u", "vec"])

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", width: int = WIDTH, step: int = STEP) -> DataFrame:
    """query_id, rank, vec_id and score (Euclidean distance) of the k nearest found of each row where is_query (on vec_id) holds."""
    spark = vectors.sparkSession
    tune(spark)
    rows = stage(usable(vectors, id_col, vec_col), "vectors").df
    # -0.0 + 0.0 is 0.0, so equal vectors have equal arrays.
    node_of = stage(rows.join(rows.groupBy("v").agg(F.min("vec_id").alias("u")), "v").select("vec_id", "u"), "nodes-of").df
    longest = F.array_max(F.transform("v", F.abs))
    reach = rows.agg(F.max(longest).alias("most"), F.min(longest).alias("least"), F.max(F.size("v")).alias("dim")).first()
    if not reach["dim"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, exponent = reach["dim"], int(np.frexp(reach["most"])[1])
    kind = np.float32 if exponent - int(np.frexp(reach["least"])[1]) <= SPREAD else np.float64
    nodes = stage(rows.join(node_of.where("vec_id = u").select("vec_id"), "vec_id").select("vec_id", "v").mapInArrow(_vec(exponent, kind), "u long, vec binary"), "nodes").df
    count = nodes.count()
    graph = neighbour_graph(nodes, count, dim)
    # Vectors and lists stay in blocks while queries, in number a share of them, come to each.
    blocks = max(6, spark.sparkContext.defaultParallelism, -(-count // MOST), -(-count * dim * kind().itemsize // HELD))
    there = stage(_packs(nodes, _send_nodes(dim, blocks)), "search-nodes").df
    lists = stage(_packs(graph.df, _send_lists(blocks)), "search-lists").df
    asked = stage(node_of.where(is_query).select(F.col("u").alias("q")).distinct(), "asked").df
    empty = F.array().cast("array<long>")
    start = asked.join(nodes, F.col("q") == F.col("u")).select("q", F.col("vec").alias("qvec"), F.array("q").alias("ids"), F.array(F.lit(0.0)).alias("ds"), F.array(F.lit(True)).alias("done"), F.array("q").alias("expand"))
    states = stage(start, "search-0")
    state_cols = "q long, qvec binary, ids array<long>, ds array<double>, done array<boolean>, expand array<long>"
    parts = max(8, -(-count // (4 * BLOCK)))
    turn, widest = 0, WIDEST * width
    while True:
        if not states.df.where(F.size("expand") > 0).limit(1).count():
            found = recalls(nodes, states.df, dim, k, SAMPLE)
            # A sample of all queries has no error.
            error = found.std() / max(len(found), 1) ** 0.5 if len(found) == SAMPLE else 0.0
            reached = not len(found) or found.mean() - 2 * error >= TARGET
            if reached or width >= min(count, widest):
                break
            width, step = 2 * width, 2 * step
            wider = states.df.select("q", "qvec", "ids", "ds", F.transform("ids", lambda _, i: i < F.lit(step)).alias("done"), F.slice("ids", 1, step).alias("expand"))
            following = stage(wider, f"wider-{width}")
            states.drop()
            states = following
        turn += 1
        going = states.df.where(F.size("expand") > 0)
        last = F.when(F.size("ids") >= width, F.array_max("ds")).otherwise(F.lit(float("inf")))
        pairs = _packs(_dealt(blocks, lists, _packs(going.select("q", "expand"), _send_expanded(blocks))), _follow(blocks))
        queries = _packs(going.select("q", "qvec", last.alias("far")), _send_queries(blocks))
        fresh = _dealt(blocks, pairs, queries, there).mapInArrow(_measure(dim), FOUND)
        now = states.df.select("q", F.lit(0).alias("kind"), "qvec", "ids", "ds", "done")
        following = stage(now.unionByName(fresh).repartition(parts, "q").sortWithinPartitions("q", "kind").mapInArrow(_update(width, step), state_cols), f"search-{turn}")
        states.drop()
        states = following
    if not reached:
        near = exact(nodes, states.df.select("q", "qvec"), count, asked.count(), dim, 2 * k + 2).groupBy("q").agg(F.collect_list("u").alias("ids"))
        states = stage(asked.join(near, "q", "left").select("q", F.coalesce("ids", empty).alias("ids")), "search-exact")
    # Nodes to their smallest ids: a query may need k of a node's, beside its own.
    members = node_of.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("u", "vec_id")
    found = states.df.select("q", F.explode(F.slice("ids", 1, 2 * k + 2)).alias("u")).unionByName(states.df.select("q", F.col("q").alias("u"))).distinct()
    pairs = node_of.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("u").alias("q")).join(found, "q").join(members, "u").where("query_id <> vec_id").select("query_id", "q", "u", "vec_id")
    vec = rows.join(node_of.where("vec_id = u").select("vec_id"), "vec_id").select(F.col("vec_id").alias("node"), "v")
    square = F.aggregate(F.zip_with("v", "v2", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    apart = pairs.select("q", "u").distinct().join(vec, F.col("u") == F.col("node")).drop("node").join(vec.withColumnRenamed("v", "v2"), F.col("q") == F.col("node")).select("q", "u", F.sqrt(square).alias("score"))
    ranked = pairs.join(apart, ["q", "u"]).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
