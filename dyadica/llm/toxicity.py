"""Toxicity by a factorization machine over hashed terms.

A text's features are the hashed terms it holds: its words in lower case, and the first four and five letters of longer ones. The
score is sigmoid(b + sum w_t + sum over pairs <v_s, v_t>), with the pair term by the usual square-of-sums identity, so
that a pair such as an insult with a group's mention has a weight of its own, which a linear model lacks.

The machine is fitted, in one task, on at most TRAIN_ROWS labelled rows, those with the smallest hash of their id, of which
that task gets the hashed terms only; equal sets of terms with one label count once. Terms in at least MIN_DOCS of these texts have weights if their own chi-square with the label is at least
CHI_SQUARE, or if the label depends on them among the texts that hold some other term (`paired`, tested on at most PAIR_ROWS of the
texts, for terms in at least PAIR_DOCS of those): others would be learned by heart. The model has a fixed size and is broadcast; every document is scored by its whole text.

Defined results: a null or empty text gets the score of no terms (the bias); labels that are null are not used; without
labels of both kinds every score is 0. Equal texts get equal scores. Other columns pass through `score`, whose own
columns replace those of the same name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GROUP_BYTES, long_rows, table, written

BITS, RANK, TRAIN_ROWS, MIN_DOCS, CHI_SQUARE, PAIR_ODDS, PAIR_ROWS, PAIR_DOCS, EPOCHS, RATE, DECAY, SEED = 18, 4, 20_000, 4, 15.0, 20, 4_000, 8, 12, 0.05, 1e-4, 7
TERM = re.compile(r"[^\W_]+")
PREFIXES = (4, 5)


def terms(text: str | None, bits: int = BITS) -> np.ndarray:
    """The distinct hashed terms of a text."""
    words = set(TERM.findall((text or "").lower()))
    words |= {w[:n] + "*" for n in PREFIXES for w in words if len(w) >= n}
    mask = (1 << bits) - 1
    return np.unique(np.fromiter((zlib.crc32(w.encode()) & mask for w in words), dtype=np.int64, count=len(words)))


def paired(docs: list[np.ndarray], labels: np.ndarray, terms_: np.ndarray, min_docs: int = MIN_DOCS) -> np.ndarray:
    """Those of terms_ that the label depends on among the texts with another of terms_, which need not matter by itself; min_docs texts have both.

    The log-likelihood ratio has to pass what chance reaches about once in PAIR_ODDS fits, so many pairs as there are.
    """
    size = len(terms_)
    at = [np.searchsorted(terms_, d[np.isin(d, terms_, assume_unique=True)]) for d in docs]
    lengths = np.array([len(d) for d in at])
    term = np.concatenate(at)
    by_term = np.repeat(np.arange(len(at), dtype=np.int32), lengths)[np.argsort(term, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=size))])
    f = np.arange(len(docs) + 1, dtype=np.float64)
    f[1:] *= np.log(f[1:])
    least = 2 * np.log(max(size, 2) ** 2 * PAIR_ODDS)
    toxic, out = labels == 1, np.zeros(size, dtype=bool)

    def count(some: np.ndarray) -> np.ndarray:
        return np.bincount(np.concatenate([at[i] for i in some]), minlength=size) if len(some) else np.zeros(size, dtype=np.int64)

    every = [(count(np.nonzero(b)[0]), b) for b in (~toxic, toxic)]
    for s in range(size):
        held = by_term[first[s] : first[s + 1]]
        n, y = len(held), int(toxic[held].sum())
        if 2 * (f[n] - f[y] - f[n - y]) < least:
            continue  # even a term that tells these texts apart would not pass
        if 2 * n > len(at):  # the texts without s are fewer
            other = np.ones(len(at), dtype=bool)
            other[held] = False
            good, bad = (a - count(np.nonzero(other & b)[0]) for a, b in every)
        else:
            good, bad = (count(held[b[held]]) for _, b in every)
        t = np.nonzero((good + bad >= min_docs) & ~out)[0]
        good, bad = good[t], bad[t]
        k = good + bad
        ratio = 2 * (f[bad] + f[good] + f[y - bad] + f[n - y - good] - f[k] - f[n - k] + f[n] - f[y] - f[n - y])
        out[t[ratio >= least]] = True
    return terms_[out]


def fit(rows: list[tuple[str, int]], bits: int = BITS, **options) -> dict | None:
    """A model of (text, label) rows; None unless both labels occur."""
    return fit_terms([(terms(t, bits), y) for t, y in rows], bits, **options)


def fit_terms(rows: list[tuple[np.ndarray, int]], bits: int = BITS, rank: int = RANK, min_docs: int = MIN_DOCS, epochs: int = EPOCHS) -> dict | None:
    """A model of (terms, label) rows."""
    once = {(d.astype("<i4").tobytes(), y) for d, y in rows}
    rows = [(np.frombuffer(raw, "<i4").astype(np.int64), y) for raw, y in sorted(once)]
    labels = np.array([y for _, y in rows], dtype=np.float64)
    if len(set(labels)) < 2:
        return None
    docs = [d for d, _ in rows]
    seen = np.bincount(np.concatenate(docs), minlength=1 << bits)
    toxic = np.bincount(np.concatenate([d for d, y in zip(docs, labels, strict=True) if y]), minlength=1 << bits)
    rng = np.random.default_rng(SEED)
    n, p = len(docs), labels.mean()
    share = np.maximum(seen * p * (1 - p) * (1 - seen / n), 1e-9)
    used = (seen >= min_docs) & ((toxic - seen * p) ** 2 / share >= CHI_SQUARE)
    some = rng.permutation(n)[:PAIR_ROWS]
    often = np.bincount(np.concatenate([docs[i] for i in some]), minlength=1 << bits) >= PAIR_DOCS
    used[paired([docs[i] for i in some], labels[some], np.nonzero(often)[0], min_docs)] = True
    docs = [d[used[d]] for d in docs]
    w, v, b = np.zeros(1 << bits), rng.normal(0, 0.01, (1 << bits, rank)), float(np.log(labels.mean() / (1 - labels.mean())))
    gw, gv = np.full(1 << bits, 1e-8), np.full((1 << bits, rank), 1e-8)
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            d = docs[i]
            x = v[d]
            total = x.sum(0)
            score = b + w[d].sum() + 0.5 * float((total * total - (x * x).sum(0)).sum())
            error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels[i]
            if abs(error) < 1e-3:
                continue
            gradient = error + DECAY * w[d]
            gw[d] += gradient**2
            w[d] -= RATE * 4 * gradient / np.sqrt(gw[d])
            gradient = error * (total - x) + DECAY * x
            gv[d] += gradient**2
            v[d] -= RATE * gradient / np.sqrt(gv[d])
            b -= 0.01 * error
    w[~used], v[~used] = 0, 0
    return {"bits": bits, "b": b, "w": w.astype("float32"), "v": v.astype("float32")}


def predict(model: dict | None, text: str | None) -> float:
    if model is None:
        return 0.0
    d = terms(text, model["bits"])
    x = model["v"][d].astype("float64")
    total = x.sum(0)
    score = model["b"] + float(model["w"][d].sum(dtype="float64")) + 0.5 * float((total * total - (x * x).sum(0)).sum())
    return float(1 / (1 + np.exp(-np.clip(score, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """docs: doc_id, text. labels: doc_id, toxic (0 or 1)."""
    import pickle

    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("labelled"), "labelled", "toxic").limit(rows)  # `rows` rows at most, so it may be broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"terms": [terms(t).astype("<i4").tobytes() for t in batch["text"]], "toxic": batch["toxic"]})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(np.frombuffer(t, "<i4").astype(np.int64), int(y)) for batch in batches for t, y in zip(batch["terms"], batch["toxic"], strict=True)]
        yield pd.DataFrame({"model": [pickle.dumps(fit_terms(held))]})

    return pickle.loads(sample.mapInPandas(hashed, "terms binary, toxic int").repartition(1).mapInPandas(learn, "model binary").first()[0])


def score(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """docs with score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** bits * (1 + rank) numbers

    @F.pandas_udf("double")
    def by_text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([predict(shared.value, t) for t in texts], dtype="float64")

    return docs.withColumn("score", by_text(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def model_of(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id")))
    return train(table(spark, sf_dir, "documents"), labels)


def query(spark, sf_dir):
    with long_rows(spark):
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        scored = score(docs, model_of(spark, sf_dir)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
        return written(scored, "scores")


def stage(spark, docs, sf_dir):
    """The documents that are not predicted toxic."""
    with long_rows(spark):
        return written(score(docs, model_of(spark, sf_dir)).where("predicted = 0").select(*docs.columns), "harmless", GROUP_BYTES)
