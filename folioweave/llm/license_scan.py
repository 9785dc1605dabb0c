"""Fuzzy search for short licence notices, and exact places of base phrases.

A notice may differ by at most k edits of characters. It is split into k + 1
disjoint pieces inside its words: k edits can't touch all of them, so one piece
stands unchanged in any match (pigeonhole). The pieces are searched exactly;
around each hit the regex library's bounded-error matching decides and gives
the span. Base phrases are found as consecutive words.

Words are runs of 0-9, a-z (after lower-casing A-Z) and non-ASCII characters.

Defined results: null text is empty and has no words; each row is scanned by
itself, so repeated rows give repeated results, and null ids stay null; texts may
have any length; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import tune
from .words import Hasher, Words, buffers

APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice, label, edits allowed, pieces (one more than the edits).
NOTICES = [
    ("gnu general public license", "gpl", 2, ("general", "public", "license")),
    ("gnu lesser general public license", "lgpl", 2, ("lesser", "public", "license")),
    ("licensed under the apache license", "apache", 2, ("licensed", "apache", "license")),
    ("released under the mit license", "mit", 2, ("released", "under", "license")),
    ("licensed under the mit license", "mit", 2, ("licensed", "under", "license")),
    ("licensed under cc by", "cc-by", 1, ("licensed", "under")),
    ("creative commons attribution", "cc-by", 2, ("creative", "commons", "attribution")),
    ("mozilla public license", "mpl", 2, ("mozilla", "public", "license")),
    ("redistribution and use in source and binary forms", "bsd", 2, ("redistribution", "source", "binary")),
    ("permission is hereby granted free of charge", "mit", 2, ("permission", "hereby", "granted")),
    ("all rights reserved", "all-rights-reserved", 1, ("rights", "reserved")),
]
SPAN = "struct<label:string,start:long,end:long,edits:int,length:int>"
SCHEMA = f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<{SPAN}>"
FOLD = bytes(32 if APART[b] else b + 32 if 65 <= b <= 90 else b for b in range(256))


def patterns(notices) -> list[list[regex.Pattern]]:
    """For each notice its patterns with 0, 1, ... edits; between words stand any separators."""
    return [[regex.compile(rb"(?<![0-9a-z\x80-\xff])(?:" + rb" +".join(n.encode().split()) + rb"){e<=%d}(?![0-9a-z\x80-\xff])" % e) for e in range(k + 1)] for n, _, k, _ in notices]


def near(folded: bytes, seeds: list[bytes], reach: int) -> list[tuple[int, int]]:
    """Merged stretches within `reach` bytes of any seed."""
    spots = []
    for seed in seeds:
        at = folded.find(seed)
        while at >= 0:
            spots.append((max(0, at - reach), min(len(folded), at + len(seed) + reach)))
            at = folded.find(seed, at + 1)
    out: list[tuple[int, int]] = []
    for a, b in sorted(spots):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def squeezed(folded: bytes) -> tuple[bytes, np.ndarray]:
    """Runs of separators as one blank, and each kept byte's place, so that a notice's length bounds what it spans."""
    x = np.frombuffer(folded, np.uint8)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    at = np.flatnonzero(keep)
    return x[at].tobytes(), at


def fuzzy(folded: bytes, notices, compiled, found: set[str]) -> list[tuple[str, int, int, int, int]]:
    """Spans (label, start, end, edits, length of the notice) of one text, fewest edits first: those of more edits stand in what the better ones leave; found: pieces that occur in the text."""
    spans, text, at = [], b"", None
    for (notice, label, _, pieces), tries in zip(notices, compiled, strict=True):
        if not found.intersection(pieces):
            continue
        if at is None:
            text, at = squeezed(folded)
        for a, b in near(text, [p.encode() for p in pieces], 2 * len(notice)):
            free, taken = [(a, b)], []
            for edits, pattern in enumerate(tries):
                rest = []
                for c, d in free:
                    # Any match holds a whole piece.
                    if not any(text.find(p.encode(), c, d) >= 0 for p in pieces):
                        continue
                    for s, e in (m.span() for m in pattern.finditer(text, c, d)):
                        taken.append((s, e, edits))
                        # The separator before a span is no part of what is left: a notice must end before it.
                        rest.append((c, max(c, s - 1)))
                        c = e
                    rest.append((c, d))
                free = rest
            spans += [(label, int(at[s]), int(at[e - 1]) + 1, edits, len(notice)) for s, e, edits in sorted(taken)]
    return spans


def scan_licenses(docs: DataFrame, base: dict[str, str] = BASE, notices=NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the base phrases' places and labels, all labels, the best match's score (1 - edits / length) and the notices' spans in bytes."""
    tune(docs.sparkSession)

    def run(batches):
        hasher, compiled = Hasher(True, APART), patterns(notices)
        phrases = [(p.encode().split(), label, hasher_of(p, hasher)) for p, label in base.items()]
        pieces = sorted({p for n in notices for p in n[3]})
        for batch in batches:
            w = Words(batch.column(1), hasher)
            counts, n = w.counts, batch.num_rows
            places: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            for parts, label, want in phrases:
                hit = np.flatnonzero(w.hash[: max(0, len(w.hash) - len(want) + 1)] == want[0])
                for k in range(1, len(want)):
                    hit = hit[w.hash[hit + k] == want[k]]
                doc = np.searchsorted(w.first, hit, "right") - 1
                for i, d in zip(hit.tolist(), doc.tolist(), strict=True):
                    if i + len(want) <= w.first[d + 1] and all(w.word(i + k).lower() == p for k, p in enumerate(parts)):
                        places[d].append((i - int(w.first[d]), label))
            folded, offsets = w.data.tobytes().translate(FOLD), w.offsets
            seen: list[set[str]] = [set() for _ in range(n)]
            for p in pieces:
                seed, at = p.encode(), -1
                while (at := folded.find(seed, at + 1)) >= 0:
                    d = int(np.searchsorted(offsets, at, "right")) - 1
                    if at + len(seed) <= offsets[d + 1]:
                        seen[d].add(p)
                        at = max(at, int(folded.rfind(seed, at, int(offsets[d + 1]))))
            rows = []
            for d in range(n):
                at = [i for i, _ in places[d]]
                own = {x for _, x in places[d]}
                spans = fuzzy(folded[offsets[d] : offsets[d + 1]], notices, compiled, seen[d]) if seen[d] else []
                score = 1.0 if own else max((1 - e / size for *_, e, size in spans), default=0.0)
                rows.append((len(at), min(at, default=None), max(at, default=None), ",".join(sorted(own)), ",".join(sorted(own | {s[0] for s in spans})), score, [dict(zip(("label", "start", "end", "edits", "length"), s, strict=True)) for s in spans]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("length", pa.int32())]))]
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [f.split()[0] for f in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def hasher_of(phrase: str, hasher: Hasher) -> np.ndarray:
    return Words(pa.array([phrase]), hasher).hash


def span_text(data: pa.Array, row: int, start: int, end: int) -> bytes:
    """The bytes of a span."""
    flat, offsets = buffers(data)
    return flat[offsets[row] + start : offsets[row] + end].tobytes()
