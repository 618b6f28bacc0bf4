"""Toxicity by a chain of linear classifiers.

The categories come in a fixed order. The model of a category sees the document's words and the log-odds that the models before
it gave. To keep those inputs honest, they are out-of-fold in training: each fold is predicted by models that did not see it.
Words are runs of ASCII letters and non-ASCII characters, lower-cased; each also counts by its first four to eight bytes, for words
that share a stem. The vocabulary is the words and stems that tell a category apart best by their chi-square statistic over a bounded sample
of labelled rows (``bound``, ``vocabulary``). Counts are corrected for continuity (Yates), so that rare words weigh by how sure they are;
words in fewer than ``LEAST`` rows of the sample tell nothing and are left out.
Every document is scored on its whole text.

Categories: ``low_quality`` (label quality 0), ``toxic`` (label toxic 1), ``severe`` (both). A document is rejected if the
probability of ``toxic`` is ``threshold`` or more.

Defined cases: a null text is empty and scored as such; without labelled rows of both classes a category gets the smoothed share of its
label (next to none without any labels: nothing is rejected then); repeated rows each get their row; empty tables give empty results;
other columns pass through ``reject_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labelled import labelled_sample
from ._shared import documents, stored

CATEGORIES = ("low_quality", "toxic", "severe")
BOUND, VOCABULARY, LEAST = 10_000, 100, 3
STEMS = (4, 5, 6, 7, 8)
_LETTERS = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def word_set(text: str | None, stems=STEMS) -> set[bytes]:
    """The distinct words of a text, and their beginnings with a star."""
    words = set((text or "").encode().translate(_LETTERS).split())
    out = set(words)
    for m in stems:
        out.update([w[:m] + b"*" for w in words if len(w) > m])
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2e-3, rounds: int = 80) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression on standardised columns, by accelerated gradients."""
    mean, spread = x.mean(0), x.std(0)
    spread[spread < 1e-9] = 1.0
    z = ((x - mean) / spread).astype(np.float32)
    n, d = z.shape
    v = np.ones(d, dtype=np.float32)
    for _ in range(15):
        v = z.T @ (z @ v)
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-9)
    step = 1 / (0.25 * max(top / n, 1.0) + ridge)
    w = u = np.zeros(d + 1, dtype=np.float32)
    share = (y.sum() + 0.5) / (n + 1)
    w[-1] = np.log(share / (1 - share))
    u = w.copy()
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ u[:-1] + u[-1])))
        g = np.append(z.T @ (p - y) / n + ridge * u[:-1], (p - y).mean()).astype(np.float32)
        new, t2 = u - step * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + ((t - 1) / t2) * (new - w), new, t2
    scale = w[:-1].astype(float) / spread
    return np.append(scale, w[-1] - (scale * mean).sum())


def model(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if 0 < y.sum() < len(y):
        return logistic(x, y)
    share = (y.sum() + 0.5) / (len(y) + 1)
    return np.append(np.zeros(x.shape[1]), np.log(share / (1 - share)))


def chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = 3) -> list[np.ndarray]:
    """One weight vector for each category: words, then the log-odds of the categories before, then the intercept."""
    part = np.unique(fold, return_inverse=True)[1] % folds
    weights = []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(np.float32)
        weights.append(model(x, y))
        if c + 1 < labels.shape[1]:
            odds = np.zeros(len(x), dtype=np.float32)
            for f in np.unique(part):
                rest = part != f
                w = model(x[rest], y[rest]) if rest.any() else weights[-1]
                odds[~rest] = x[~rest] @ w[:-1] + w[-1]
            x = np.hstack([x, np.clip(odds, -8, 8)[:, None]])
    return weights


class Toxicity:
    def __init__(self, vocabulary: list[bytes], weights: list[np.ndarray]) -> None:
        self.place = {w: i for i, w in enumerate(vocabulary)}
        self.known = frozenset(vocabulary)
        self.stems = sorted({len(w) - 1 for w in vocabulary if w.endswith(b"*")})
        self.words = np.array([w[: len(vocabulary)] for w in weights])
        self.rest = [w[len(vocabulary) :] for w in weights]

    def __call__(self, text: str | None) -> list[float]:
        at = [self.place[w] for w in word_set(text, self.stems) & self.known]
        base = self.words[:, at].sum(1)
        odds: list[float] = []
        for b, rest in zip(base, self.rest, strict=True):
            odds.append(float(np.clip(b + rest[-1] + np.dot(rest[:-1], odds), -8, 8)))
        return [1 / (1 + np.exp(-o)) for o in odds]


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND, vocabulary: int = VOCABULARY) -> Toxicity:
    sample = labelled_sample(docs, labels, ["quality", "toxic"], bound, held_out=None)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [sorted(word_set(t.as_py())) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(words, pa.list_(pa.binary()))], ["doc_id", "fold", "quality", "toxic", "words"])

    rows, _ = stored(sample.mapInArrow(split, "doc_id long, fold int, quality int, toxic int, words array<binary>"), "toxic")
    rows = rows.withColumns({"low_quality": 1 - F.col("quality"), "severe": F.col("toxic") * (1 - F.col("quality"))})
    totals = rows.agg(F.count("*"), *(F.coalesce(F.sum(c), F.lit(0)) for c in CATEGORIES)).first()
    n, sums = totals[0], totals[1:]
    if not n:
        return Toxicity([], [np.append(np.zeros(c), -8.0) for c in range(len(CATEGORIES))])
    by_word = rows.select(F.explode("words").alias("word"), *CATEGORIES).groupBy("word").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in CATEGORIES)).where(F.col("n") >= LEAST)
    chosen: set[bytes] = set()
    for c, s in zip(CATEGORIES, sums, strict=True):
        a, k = F.col(c), F.col("n")
        gap = a * F.lit(float(n)) - k * F.lit(float(s))
        sure = F.greatest(F.abs(gap) - n / 2, F.lit(0.0))
        chi = sure * sure / (k * (F.lit(float(n)) - k) + 1) * F.signum(gap)
        chosen |= {bytes(r.word) for r in by_word.orderBy(chi.desc(), "word").limit(vocabulary).collect()}
    words = sorted(chosen)
    place = {w: i for i, w in enumerate(words)}

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [[place[w] for w in own if w in place] for own in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(at, pa.list_(pa.int32()))], ["doc_id", "fold", "quality", "toxic", "at"])

    got = rows.select("doc_id", "fold", "quality", "toxic", "words").mapInArrow(found, "doc_id long, fold int, quality int, toxic int, at array<int>").orderBy("doc_id").collect()  # at most the bound
    x = np.zeros((len(got), len(words)), dtype=np.float32)
    for i, r in enumerate(got):
        x[i, r["at"]] = 1
    low, toxic = 1 - np.array([r.quality for r in got]), np.array([r.toxic for r in got])
    return Toxicity(words, chain(x, np.stack([low, toxic, low * toxic], 1), np.array([r.fold for r in got])))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The columns of ``docs`` as struct ``row``, the categories' probabilities and ``rejected``."""
    chained = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))  # a few hundred words

    @F.pandas_udf("low_quality double, toxic double, severe double")
    def judge(text):
        import pandas as pd

        return pd.DataFrame([chained.value(t) for t in text], columns=list(CATEGORIES), dtype=float)

    p = docs.select(F.struct("*").alias("row"), judge(F.coalesce(F.col("text"), F.lit(""))).alias("p"))
    return p.select("row", "p.*", (F.col("p.toxic") >= threshold).alias("rejected"))


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """``docs`` without the rejected documents, columns as they are."""
    return score(docs, labels, threshold, **options).where(~F.col("rejected")).select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("row.doc_id", *(F.col(c).alias(f"p_{c}") for c in CATEGORIES), "rejected")
