"""Quality filter: a document classifier combined with host and path posteriors by hierarchical empirical Bayes.

The classifier has two heads, one against toxic and one against low-quality
texts, over measures of form and a lexicon of words that toxic labels single
out. It is fitted on at most `sample` labelled rows (those with the smallest
hashes of their id). All else covers all documents.

Hosts and paths get posterior rates of acceptable documents: a path's rate is
shrunk to its host's, a host's to the global one. A path is known by its host
and its name together. The prior strengths come from
the spread of the rates over all hosts and paths (method of moments), so sparse
sites fall back and well-covered ones speak for themselves. A document's own
vote is taken out of its path's and host's rates. Its odds are the classifier's
times the site's odds over the global odds.

Parameters that bound the model, none of which leaves a document out: `sample`
labelled rows; a lexicon of `lexicon` words, each in at least `least_docs` toxic
documents of the sample and `least_odds` times as likely there. A site moves the
log odds by at most `most_shift`: its rates come from the same classifier, so
they are no independent evidence, and a good document of a bad site can stay.
Rates of 0 and 1 are taken for 1e-9 and 1 - 1e-9, so that odds are finite.

Defined results: null text is empty, null hosts and paths are the empty string,
each row is scored and kept or dropped by itself, also where ids repeat or are
null; a null score (no rows at all) keeps nothing; without labels of both kinds a
head gives its base rate; labels of one id that differ count as the lower quality
and as toxic; of a labelled id's rows the smallest text is
fitted on; other columns are ignored unless they are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import found as among
from .license_scan import APART
from .store import stage, trimmed, tune
from .words import Hasher, Words

SAMPLE, LEXICON = 20_000, 5_000
LEAST_DOCS, LEAST_ODDS = 3, 8.0
MOST_SHIFT = 2.0
#: Rows of paths that may be broadcast; more are joined by shuffle.
FEW_PATHS = 100_000
N_FORM = 9
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "*&%$#@^~<>{}[]\\_=+"]] = True
MARKS = np.zeros(256, bool)
MARKS[[ord("!"), ord("|")]] = True
UPPER, DIGIT = np.zeros(256, bool), np.zeros(256, bool)
UPPER[65:91] = True
DIGIT[48:58] = True


def measures(texts: pa.Array, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """A row for each text: nine measures of form, then hits, sum and greatest weight of the lexicon's words."""
    w = Words(texts, Hasher(True, APART))
    size, counts = np.diff(w.offsets), w.counts
    share = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[w.data])])[w.offsets]) / np.maximum(size, 1)
    first = w.first.tolist()
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(first, first[1:], strict=False)], np.int64)
    again = np.zeros(len(w.hash) + 1, np.int64)
    again[2:] = np.cumsum(w.hash[1:] == w.hash[:-1])
    edges = np.minimum(w.first[:-1] + 1, w.first[1:])
    repeats = again[w.first[1:]] - again[edges]
    n = np.maximum(counts, 1)
    log_n = np.log1p(counts)
    hit, at = among(w.hash, keys)
    weight = np.where(hit, weights[at] if len(weights) else 0.0, 0.0)
    doc = np.repeat(np.arange(len(counts)), counts)
    hits, total, most = np.bincount(doc, hit, len(counts)), np.bincount(doc, weight, len(counts)), np.zeros(len(counts))
    np.maximum.at(most, doc[hit], weight[hit])
    form = [share(SYMBOLS), share(MARKS), share(UPPER), share(DIGIT), distinct / n, distinct / n * log_n, repeats / n, log_n, size / n / 10]
    return np.stack([*form, np.log1p(hits), np.log1p(total), most], axis=1)


class Head:
    """Logistic regression on standardized measures with a small ridge, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.concatenate([np.ones((len(x), 1)), np.clip((x - self.mean) / self.scale, -8, 8)], 1)
        base = (y.sum() + 0.5) / (len(y) + 1)
        self.beta = np.zeros(z.shape[1])
        self.beta[0] = np.log(base / (1 - base))
        if not 0 < y.sum() < len(y):
            return
        penalty = np.diag([0.0] + [ridge] * x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty + 1e-9 * np.eye(z.shape[1]), z.T @ (y - p) - penalty @ self.beta)
            self.beta += step
            if np.abs(step).max() < 1e-6:
                break

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + z @ self.beta[1:], -30, 30)))


class Model:
    """The lexicon and both heads; of bounded size."""

    def __init__(self, keys, weights, toxic: Head, good: Head):
        self.keys, self.weights, self.toxic, self.good = keys, weights, toxic, good

    def acceptable(self, texts: pa.Array) -> np.ndarray:
        x = measures(texts, self.keys, self.weights)
        return (1 - self.toxic(x[:, N_FORM:])) * self.good(x[:, :N_FORM])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lexicon: int = LEXICON, least_docs: int = LEAST_DOCS, least_odds: float = LEAST_ODDS) -> Model:
    """docs (doc_id, text), labels (doc_id, quality, toxic). Of the sample's documents two thirds make the lexicon, the others fit the heads."""
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most `sample` rows of three numbers; of a repeated id the smallest text is fitted on, so the table keeps that bound.
    found = docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("text").alias("text"))
    table = stage(found.select("text", "quality", "toxic", (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0).alias("held")), "labelled")

    def words(batches):
        for batch in batches:
            w, toxic = Words(batch.column(0), Hasher(True, APART)), np.array(batch.column(1).to_pylist(), np.int64)
            first = w.first.tolist()
            per = [np.unique(w.hash[a:b]) for a, b in zip(first, first[1:], strict=False)]
            if not per:
                continue
            flat, label = np.concatenate(per), np.repeat(toxic, [len(p) for p in per])
            keys, back = np.unique(flat, return_inverse=True)
            yield pa.record_batch([pa.array(keys.view(np.int64)), pa.array(np.bincount(back, label, len(keys)).astype(np.int64)), pa.array(np.bincount(back, 1 - label, len(keys)).astype(np.int64))], ["h", "bad", "fine"])

    fold = table.df.where("NOT held")
    size = fold.agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).first()
    bad, fine = size["bad"] or 0, (size["n"] or 0) - (size["bad"] or 0)
    odds = (F.col("bad") + 0.5) / (bad + 1) / ((F.col("fine") + 0.5) / (fine + 1))
    counted = fold.select("text", "toxic").mapInArrow(words, "h long, bad long, fine long").groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    top = counted.where(F.col("bad") >= least_docs).withColumn("odds", odds).where(F.col("odds") >= least_odds).orderBy(F.desc("odds"), "h").limit(lexicon).collect()
    keys, weights = np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([np.log(r["odds"]) for r in top])
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]

    def rows(batches):
        for batch in batches:
            x = measures(batch.column(0), keys, weights)
            yield pa.record_batch([pa.array(list(x), pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["x", "quality", "toxic"])

    seen = table.df.where("held").select("text", "quality", "toxic").mapInArrow(rows, "x array<double>, quality int, toxic int").collect()  # under half the sample
    table.drop()
    x = np.array([r["x"] for r in seen]).reshape(len(seen), N_FORM + 3) if seen else np.zeros((1, N_FORM + 3))
    quality = np.array([r["quality"] for r in seen] or [1], float)
    toxic = np.array([r["toxic"] for r in seen] or [0], float)
    return Model(keys, weights, Head(x[:, N_FORM:], toxic), Head(x[:, :N_FORM], quality))


def _strength(groups: DataFrame, rate: Column, prior: Column) -> float:
    """Method of moments: how many documents the prior is worth."""
    n, p, m = F.col("n"), rate, prior
    row = groups.where("n > 1").agg(F.sum(n).alias("n"), F.sum(n * (p - m) * (p - m)).alias("spread"), F.sum(m * (1 - m)).alias("noise"), F.sum(n * m * (1 - m)).alias("scale")).first()
    if not row["n"]:
        return 100.0
    between = max(row["spread"] - row["noise"], 0.0) / row["n"]
    within = row["scale"] / row["n"]
    return float(min(max(within / max(between, 1e-9) - 1, 1.0), 1e6))


def score(docs: DataFrame, labels: DataFrame, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", carried: str | None = None, most_shift: float = MOST_SHIFT, **bounds) -> DataFrame:
    """doc_id, host, path, doc_score, site_score and score (posterior chance of being acceptable) of each row; carried: a column that each row keeps; bounds: those of fit()."""
    tune(docs.sparkSession)
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), plain(host_col).alias("host"), plain(path_col).alias("path"), *([F.col(carried).alias("carried")] if carried else []))
    model = fit(docs.select("doc_id", "text"), labels, **bounds)

    def run(batches):
        for batch in batches:
            kept = [batch.column(c) for c in ("doc_id", "host", "path")]
            yield pa.record_batch([*kept, pa.array(model.acceptable(batch.column("text"))), *([batch.column("carried")] if carried else [])], ["doc_id", "host", "path", "doc_score", *["carried"] * bool(carried)])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("host", T.StringType()), T.StructField("path", T.StringType()), T.StructField("doc_score", T.DoubleType())])
    if carried:
        schema = schema.add("carried", docs.schema["carried"].dataType)
    scored = stage(docs.mapInArrow(trimmed(run), schema), "scores").df
    return with_sites(scored, carried, most_shift)


def with_sites(scored: DataFrame, carried: str | None = None, most_shift: float = MOST_SHIFT) -> DataFrame:
    """scored (doc_id, host, path, doc_score) with the sites' posteriors and the final score."""
    paths = stage(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("doc_score").alias("good")), "paths").df
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = hosts.agg(F.coalesce(F.sum("good"), F.lit(0.0)).alias("good"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    mean = (total["good"] + 0.5) / (total["n"] + 1)
    of_host = _strength(hosts, F.col("good") / F.col("n"), F.lit(mean))
    both = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("good").alias("host_good")), "host")
    rate = (F.col("host_good") + mean * of_host) / (F.col("host_n") + of_host)
    of_path = _strength(both, F.col("good") / F.col("n"), rate)
    sites = stage(both.select("host", "path", "n", "good", "host_n", "host_good"), "sites").df
    # Few paths are broadcast, so a source of a third of all rows is no task of its own; many are joined by shuffle, where AQE splits a large one.
    sites = F.broadcast(sites) if sites.count() <= FEW_PATHS else sites
    p = F.col("doc_score")
    own_host = (F.col("host_good") - p + mean * of_host) / (F.col("host_n") - 1 + of_host)
    own_path = (F.col("good") - p + own_host * of_path) / (F.col("n") - 1 + of_path)
    bounded = lambda x: F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9))
    logit = lambda x: F.log(bounded(x) / (1 - bounded(x)))
    shift = F.least(F.greatest(logit(F.col("site_score")) - float(np.log(mean / (1 - mean))), F.lit(-most_shift)), F.lit(most_shift))
    out = scored.join(sites, ["host", "path"]).withColumn("site_score", own_path)
    return out.select("doc_id", "host", "path", "doc_score", "site_score", (1 / (1 + F.exp(-(logit(p) + shift)))).alias("score"), *([F.col("carried").alias(carried)] if carried else []))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **columns) -> DataFrame:
    """The rows of score() at or over the threshold."""
    return score(docs, labels, **columns).where(F.col("score") >= threshold)
