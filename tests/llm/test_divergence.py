"""Source divergence against its definition in Python integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioweave.llm import divergence

from .test_ops import LOWER, empty  # noqa: F401

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least, top):
    counts, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(terms)
        held[lang].update(set(terms))
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        share = lambda n, total: 1 + 10**9 * (n + 5) // (total + 5 * len(kept))  # noqa: B023, E731
        p = {s: {t: share(counts[lang, s][t], sum(counts[lang, s][u] for u in kept)) for t in kept} for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: share(whole[t], sum(whole.values())) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, i + 1) for i, (v, o) in enumerate(pairs)}
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if counts[lang, s][t] and p[s][t] > q[t])[:top]
            out |= {(lang, s, "term", t.decode(), -v, i + 1) for i, (v, t) in enumerate(terms)}
    return out


def data(seed, n=240):
    rng = random.Random(seed)
    words = [*(f"w{chr(97 + i)}" for i in range(26)), "Über", "über", "ÜBER", "日本", "It's", "a1b", "É", "🙂x", "[Zz]", "_"]
    out = []
    for _ in range(n):
        source = rng.choice(["s1", "s1", "s1", "s2", "ß", "🙂", "", None])
        lang = rng.choice(["en", "en", "en", "de", None, "xx"])
        text = rng.choice([None, "", " 12 ", *[" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(9)]])
        out.append((lang, source, text))
    return out + [("only", "one", "a b"), ("bare", "x", "1 2"), ("bare", "y", None)]


@pytest.mark.parametrize(("seed", "least", "top"), [(1, 30, 50), (2, 5, 3), (3, 1, 50), (4, 10**6, 50)])
def test_all_rows(spark, seed, least, top):
    rows = data(seed)
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "lang string, source string, text string, rank int, item string").repartition(3)
    got = [tuple(r) for r in divergence.source_divergence(df, least, top=top).select("lang", "source", "part", "item", "value", "rank").collect()]
    want = brute(rows, least, top)
    assert len(got) == len(want) and set(got) == want


def test_repeated_rows_empty_and_long(spark):
    rows = [("en", "a", "x y " * 200_000), ("en", "b", "x"), ("en", "b", "x")] + [("en", "c", "x z")] * 40
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert {tuple(r) for r in divergence.source_divergence(df, 3).select("lang", "source", "part", "item", "value", "rank").collect()} == brute(rows, 3, 50)
    assert divergence.source_divergence(spark.createDataFrame([], df.schema)).isEmpty()


def test_shares_of_large_counts(spark):
    n, total, terms = 3 * 10**15 + 7, 9 * 10**15 + 1, 10**9
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(terms), 5)).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * terms)
