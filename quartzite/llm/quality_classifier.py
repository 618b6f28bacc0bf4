"""Quality scores: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Document statistics (whole texts) are standardised and mapped to cosines of random projections, whose inner products
approximate a Gaussian kernel. Every partition of the labelled sample adds up its own Gram matrix, one for each fold; the sums meet
in Spark, row by row of the matrix, and only they reach the driver. The ridge solutions without one fold each score that
fold; pooling adjacent violators over these out-of-fold scores gives the calibration to probabilities.

The fit uses a bounded sample of labelled rows (``bound``); every document is scored.

Defined cases: a null text is empty; empty texts get the score of empty statistics; no labelled rows, or only one class of them,
give every document the smoothed share of label 1 (0.5 without any); repeated rows each get their row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._labelled import fold_of, labelled_sample
from ._shared import documents, stored

FEATURES, WIDTH, RIDGE, BOUND, SEED = 256, 4.0, 3.0, 12_000, 20_241
_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"#*$%&|<>", b"|", b".", b",", b"!?", b"\"'()[]{}", b"=/\\_@:;-+", bytes(range(128, 256))]
_MASK = np.array([[c in g for c in range(256)] for g in _GROUPS], dtype=float)
N_STATS = len(_GROUPS) + 9


def statistics(text: str | None) -> np.ndarray:
    """Shape, character classes and repetition of one whole text."""
    data = (text or "").encode()
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, w, m = len(data), len(words), len(lines)
    out = np.zeros(N_STATS)
    k = len(_GROUPS)
    if w:
        share = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) / n
        out[:k] = np.sqrt(_MASK @ share)
        seen = share[share > 0]
        windows = max(1, w - 2)
        short = data.lower().split()
        out[k:] = (
            np.log1p(w),
            np.log1p(m),
            np.log1p(w / m),
            sum(map(len, words)) / w / 10,
            len(set(short)) / w,
            len(set(words)) / max(1, len(set(short))),
            1 - len(set(zip(short, short[1:], short[2:], strict=False))) / windows if w > 2 else 0,
            1 - len(set(lines)) / m,
            -(seen * np.log2(seen)).sum() / 5,
        )
    return out


class Fourier:
    """The random features of standardised statistics; the same for the same seed."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, features: int, width: float) -> None:
        r = np.random.default_rng(SEED)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w, self.b = r.normal(size=(N_STATS, features)) / width, r.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        cosines = np.sqrt(2 / self.w.shape[1]) * np.cos(z @ self.w + self.b)
        return np.hstack([cosines, np.ones((len(x), 1))])


def summed(rows: DataFrame, fn, width: int) -> dict[tuple[int, int], np.ndarray]:
    """Partition sums: ``fn(batch)`` gives {(fold, i): vector}; each partition adds its own up, then Spark adds those by key."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for key, v in fn(batch).items():
                own[key] = own[key] + v if key in own else v
        for (fold, i), v in own.items():
            yield pa.RecordBatch.from_arrays([pa.array([fold], pa.int32()), pa.array([i], pa.int32()), pa.array([v.tolist()], pa.list_(pa.float64()))], ["fold", "i", "v"])

    def total(table: pa.Table) -> pa.Table:
        v = sum(np.array(x.as_py()) for x in table.column("v"))
        return pa.table({"fold": table.column("fold")[:1], "i": table.column("i")[:1], "v": pa.array([v.tolist()], pa.list_(pa.float64()))})

    schema = "fold int, i int, v array<double>"
    got = rows.mapInArrow(partial, schema).groupBy("fold", "i").applyInArrow(total, schema).collect()  # folds x width rows
    return {(r.fold, r.i): np.array(r.v) for r in got}


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on score (pool adjacent violators); blocks get one pseudo-count each way."""
    order = np.lexsort((y, score))
    blocks: list[list[float]] = []  # first score, last score, n, sum
    for s, t in zip(score[order], y[order], strict=True):
        if blocks and blocks[-1][1] == s:
            blocks[-1][2] += 1
            blocks[-1][3] += t
        else:
            blocks.append([s, s, 1, t])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            _, last, n, total = blocks.pop()
            blocks[-1][1:] = [last, blocks[-1][2] + n, blocks[-1][3] + total]
    knots = np.array([[x, (b[3] + 0.5) / (b[2] + 1)] for b in blocks for x in (b[0], b[1])])
    return knots[:, 0], np.maximum.accumulate(knots[:, 1])


def stacked(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float).reshape(len(column), -1)


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND, features: int = FEATURES, width: float = WIDTH, ridge: float = RIDGE):
    """A function from statistics (rows) to calibrated scores."""
    sample = labelled_sample(docs, labels, ["quality"], bound)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), pa.array([statistics(t.as_py()).tolist() for t in b.column(1)], pa.list_(pa.float64()))], ["fold", "y", "x"])

    rows, _ = stored(sample.mapInArrow(measured, "fold int, y int, x array<double>"), "labelled")

    def moments(b: pa.RecordBatch) -> dict:
        x, y = stacked(b.column(2)), np.array(b.column(1))
        return {(0, 0): np.concatenate([[len(x), y.sum()], x.sum(0), (x * x).sum(0)])} if len(x) else {}

    m = summed(rows, moments, 1).get((0, 0), np.zeros(2 + 2 * N_STATS))
    n, positive = m[0], m[1]
    if not 0 < positive < n:
        share = (positive + 0.5) / (n + 1)
        return lambda x: np.full(len(x), share)
    mean = m[2 : 2 + N_STATS] / n
    fourier = Fourier(mean, np.sqrt(np.maximum(m[2 + N_STATS :] / n - mean**2, 0)), features, width)

    def gram(b: pa.RecordBatch) -> dict:
        fold, y, x = np.array(b.column(0)), np.array(b.column(1), dtype=float), stacked(b.column(2))
        out = {}
        for f in np.unique(fold):
            z = fourier(x[fold == f])
            for i, v in enumerate(z.T @ np.hstack([z, y[fold == f][:, None]])):
                out[int(f), i] = v
        return out

    sums = summed(rows, gram, features + 1)
    folds = sorted({f for f, _ in sums})
    by_fold = {f: np.array([sums[f, i] for i in range(features + 1)]) for f in folds}
    whole = sum(by_fold.values())
    solve = lambda a: np.linalg.solve(a[:, :-1] + ridge * np.eye(features + 1), a[:, -1])
    weights, without = solve(whole), {f: solve(whole - by_fold[f]) if len(folds) > 1 else solve(whole) for f in folds}

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                z, w = fourier(stacked(b.column(2))), np.array([without[f] for f in b.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array((z * w).sum(1))], ["y", "s"])

    pairs = np.array([(r.s, r.y) for r in rows.mapInArrow(scored, "y int, s double").collect()])  # at most the bound
    xs, ys = isotonic(pairs[:, 0], pairs[:, 1])
    return lambda x: np.clip(np.interp(fourier(x) @ weights, xs, ys), 0.0, 1.0)


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score of each row of ``docs``."""
    model = fit(docs, labels, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 2000):
                part = b.slice(i, 2000)
                x = np.array([statistics(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model(x))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")
    return out.select("doc_id", (F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id")) == 0)).alias("held_out"), "score")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
