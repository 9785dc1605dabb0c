"""Runs of repeated words: stretches of a document with a period that fits three times or more.

Blocks of 2**j words get names (Karp, Miller and Rosenberg): a block's name is
the pair of the names of its halves, numbered. Equal names are equal blocks, so
nothing is hashed. A run of period p that is 3 * p long holds two neighbouring
blocks [k * p, (k + 1) * p) and [(k + 1) * p, (k + 2) * p) of the grid of p that
are equal, and whether they are is seen from two names each. Places that pass
are extended both ways by descending name levels. The grids of all periods of a
document of n words have n * ln(n) places.

A run is also 24 words long at least and fits its period three times, so 16 of
its words come again in the document: documents without two equal names of 16
words have no runs. Documents are worked on side by side, those of about the
same length together; a row never leaves its task, so there is no shuffle.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import trimmed, tune

LEAST, TIMES = 24, 3
#: Words that are worked on together (a longer document goes alone), and grid places at a time.
TOGETHER, PLACES = 1 << 18, 1 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def pairs_named(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of pairs of numbers from 0, equal where the pairs are."""
    return np.unique(a.astype(np.int64) * (int(b.max(initial=0)) + 1) + b, return_inverse=True)[1].astype(np.int32)


class Names:
    """Names of the blocks of 2**j words from each place of some documents that stand one behind the other."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        self.levels = [words]
        self.sizes, self.doc = sizes, np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        self.begin, self.end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)

    def level(self, j: int) -> np.ndarray:
        """Blocks that go over a document's end have a name that no other has."""
        while len(self.levels) <= j:
            half, below = 1 << (len(self.levels) - 1), self.levels[-1]
            n = len(below)
            inside = np.arange(n) + 2 * half <= self.end
            at = np.flatnonzero(inside)
            now = np.arange(n, dtype=np.int32)
            now[~inside] += n
            now[at] = pairs_named(below[at], below[at + half])
            self.levels.append(now)
        return self.levels[j]

    def equal(self, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Whether the p words from a are those from b, all inside of one document."""
        out = np.zeros(len(a), bool)
        j = np.frexp(p.astype(float))[1] - 1
        for k in np.unique(j).tolist():
            now = np.flatnonzero(j == k)
            names, late = self.level(k), p[now] - (1 << k)
            out[now] = (names[a[now]] == names[b[now]]) & (names[a[now] + late] == names[b[now] + late])
        return out

    def further(self, a: np.ndarray, b: np.ndarray, top: int, back: bool) -> np.ndarray:
        """How many words from a on are those from b on (a < b); back: how many before them."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for j in range(top, -1, -1):
            names, size = self.level(j), 1 << j
            while len(live):
                x = a[live] - out[live] - size if back else a[live] + out[live]
                y = x + (b[live] - a[live])
                room = x >= self.begin[a[live]] if back else y + size <= self.end[a[live]]
                hit = live[room][names[x[room]] == names[y[room]]]
                out[hit] += size
                # The top level goes on as long as blocks agree; below it one step is enough.
                live = hit if j == top else live[:0]
            live = np.arange(len(a))
        return out


def runs_of(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs of documents of word numbers, ordered by them; start counts from the document's first word."""
    none = (np.zeros(0, np.int64),) * 4
    names = Names(words, sizes)
    at = np.flatnonzero(np.arange(len(words)) + 16 <= names.end)
    if not len(at):
        return none
    key = pairs_named(names.doc[at], names.level(4)[at])
    again = np.zeros(len(sizes), bool)
    again[names.doc[at[np.bincount(key)[key] > 1]]] = True
    if not again.any():
        return none
    if not again.all():
        which = np.flatnonzero(again)
        doc, *rest = runs_of(words[again[names.doc]], sizes[again])
        return (which[doc], *rest)
    first = np.cumsum(sizes) - sizes
    found: list[list[np.ndarray]] = []
    p = 1
    longest = int(sizes.max()) // TIMES
    while p <= longest:
        # As many periods at once as have PLACES grid places.
        q, total = p, 0
        while q <= longest and (q == p or total < PLACES):
            total += int((sizes[sizes >= TIMES * q] // q).sum())
            q += 1
        docs, periods = np.meshgrid(np.arange(len(sizes)), np.arange(p, q), indexing="ij")
        docs, periods = docs.ravel(), periods.ravel()
        places = np.maximum(sizes[docs] // periods - 1, 0) * (sizes[docs] >= np.maximum(TIMES * periods, LEAST))
        d, period = np.repeat(docs, places), np.repeat(periods, places)
        a = first[d] + period * (np.arange(len(d)) - np.repeat(np.cumsum(places) - places, places))
        hit = names.equal(a, a + period, period)
        a, period, d = a[hit], period[hit], d[hit]
        # Neighbouring places of one run give it once: only the first goes on.
        new = np.ones(len(a), bool)
        new[1:] = (period[1:] != period[:-1]) | (d[1:] != d[:-1]) | (a[1:] != a[:-1] + period[1:])
        found.append([x[new] for x in (d, a, period)])
        p = q
    d, a, period = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(a):
        return none
    top = max(0, int(np.log2(max(1, int(sizes.max()) // TIMES))))
    before, after = names.further(a, a + period, top, True), names.further(a, a + period, top, False)
    start, length = a - before, before + after + period
    long = length >= np.maximum(LEAST, TIMES * period)
    d, start, length, period = d[long], start[long] - first[d[long]], length[long], period[long]
    # A stretch has all multiples of its smallest period, too: the smallest counts.
    order = np.lexsort((period, length, start, d))
    d, start, length, period = d[order], start[order], length[order], period[order]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != d[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    d, start, length, period = d[keep], start[keep], length[keep], period[keep]
    order = np.lexsort((period, start, d))
    return d[order], start[order], length[order], period[order]


def strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run with the greatest exact length / period; ties: smallest start, then period."""
    ratio = length / period
    near = np.flatnonzero(ratio >= ratio.max() * (1 - 1e-9))
    return int(min(near, key=lambda i: (-Fraction(int(length[i]), int(period[i])), start[i], period[i])))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's runs and what is left of it when each run keeps its first period only.

    Returns doc_id, n_words, runs (array of start, length, period; by start, then
    period; words count from 0), strongest (the run of the greatest exact
    length / period, or null) and collapsed (the kept words, joined by one space).
    Words are stretches without space, tab, LF, VT, FF and CR, unchanged.

    Defined results: null and empty texts have no words, no runs and an empty
    collapsed text; ids may be null or repeat (each row is judged by itself);
    texts may have any length; other columns are left out; an empty table gives no rows.
    """
    tune(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).to_pylist()
            words = [(t or b"").split() for t in texts]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            order = np.argsort(sizes, kind="stable")
            found: list[list[tuple[int, int, int]]] = [[] for _ in words]
            group: list[int] = []
            held = 0
            for i in order.tolist():
                # Documents of which one is more than twice as long as another don't go together.
                if group and (held + sizes[i] > TOGETHER or sizes[i] > 2 * max(LEAST, sizes[group[0]])):
                    _search(words, sizes, group, found)
                    group, held = [], 0
                if sizes[i] >= LEAST:
                    group.append(i)
                    held += int(sizes[i])
            _search(words, sizes, group, found)
            best, collapsed = [], []
            for ws, runs in zip(words, found, strict=True):
                if runs:
                    start, length, period = np.array(runs, np.int64).T
                    best.append(runs[strongest(start, length, period)])
                    step = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(step, start + period, 1)
                    np.add.at(step, start + length, -1)
                    ws = [w for w, k in zip(ws, np.cumsum(step)[:-1].tolist(), strict=True) if not k]
                else:
                    best.append(None)
                collapsed.append(b" ".join(ws).decode("utf-8", "surrogatepass"))
            one = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
            named = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
            yield pa.record_batch({"doc_id": batch.column(0), "n_words": pa.array(sizes), "runs": pa.array([list(map(named, r)) for r in found], pa.list_(one)), "strongest": pa.array(list(map(named, best)), one), "collapsed": pa.array(collapsed, pa.string())})

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return kept.mapInArrow(trimmed(run), f"doc_id long, n_words long, runs {RUNS}, strongest {RUNS[6:-1]}, collapsed string")


def _search(words: list[list[bytes]], sizes: np.ndarray, group: list[int], found: list[list[tuple[int, int, int]]]) -> None:
    """Adds the runs of a group of documents to found."""
    if not group:
        return
    known: dict[bytes, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for i in group for w in words[i]), np.int32, int(sizes[group].sum()))
    for d, *run in zip(*(x.tolist() for x in runs_of(flat, sizes[group])), strict=True):
        found[group[d]].append(tuple(run))


def runs_text(runs: Column) -> Column:
    """One line `start,length,period` for each run, each ended by a line feed."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")


def echoed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, where about one in ten, chosen by its id, repeats a stretch of its words to its end.

    With h the CRC-32 of the id in decimal and g = h // 10, a text of n > 0 words
    and h % 10 = 0 has its words from a = g % n on replaced by the p = 1 + (n - a)
    // (3 + g % 8) words from a on, again and again; its words are then joined by one
    space. Other rows, and those whose id or text is null, stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))
    n, g = F.size("_words").cast("long"), F.floor(h / 10)
    chosen = F.coalesce(h % 10 == 0, F.lit(False))
    place = F.struct(F.pmod(g, n).alias("a"))
    rows = docs.withColumn("_words", F.when(chosen, words)).withColumn("_at", F.when(n > 0, place)["a"])
    p = 1 + F.floor((n - F.col("_at")) / (3 + g % 8))
    rows = rows.withColumn("_period", p)
    rest = F.transform(F.sequence(F.lit(0).cast("long"), n - F.col("_at") - 1), lambda i: F.element_at("_words", (F.col("_at") + i % F.col("_period") + 1).cast("int")))
    again = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_at").cast("int")), rest), " ")
    return rows.withColumn(text_col, F.when(F.col("_at").isNotNull(), again).otherwise(F.col(text_col))).drop("_words", "_at", "_period")
