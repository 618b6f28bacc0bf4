"""Exact top-k search by inner product as a Voronoi kNN join.

Rows and queries go to the cell of the nearest pivot. What the join knows of a cell is its summary: for queries their number and radius a, for
data the number of rows and the few smallest distances to the pivot. With a query q of the cell of pivot p and a row at distance e from its
pivot s, the inner product differs from p.s by |p| e + a |s| + a e at most.

* A bound by query cell: the rows that the summaries tell of score at least p.s - (|p| e + a |s| + a e) with every query of the cell. The k-th largest
  of these numbers, theta, is reached by the k best of all of its queries.
* A row is sent to a query cell only if p.s + (|p| e + a |s| + a e) is at least theta: in each cell the rows from some distance e on.
* Neighbouring query cells are put together to groups of about ``query_block`` queries, and a row goes to a group once, so that what must be
  replicated is replicated by queries / ``query_block`` at most. Groups are cut into blocks of ``query_block`` queries and ``block`` rows by
  hash, solved locally by matrix products, and the local winners meet by query.

Pivots are a bounded sample: the rows with the least hash of their id, four times the root of the number of rows, at most ``pivots``. All that
reaches the driver are summaries, ``pivots`` times k + 4 numbers or so.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without id; where lengths differ, missing
components count as 0, so an empty vector scores 0 with all; repeated ids each count as a row of its own and as a query of its own, and all
rows but those of the query's id are candidates; ties go to the smaller id; fewer candidates than k give fewer rows; scores are exact integers
at any size of the components (beyond 2^53 by whole-number arithmetic), but stop at the ends of a long, where ties go to the smaller id too; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import stored

PIVOTS, BLOCK, QUERY_BLOCK = 1024, 8192, 2048
#: Queries whose scores with a block of rows are held at once.
AT_ONCE = 256
LONG = np.iinfo(np.int64)


def usable(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """id and v (floor(scale * x), whole numbers as doubles) of the rows that take part."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").where(sound)
    # doubles from 2^52 on are whole
    whole = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    return rows.select("id", F.transform("v", lambda x: whole(x * scale)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The vectors of a list column as rows; shorter ones end in zeros."""
    flat, size = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
    if len(size) and size.min() == size.max() == width:
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


class Geometry:
    """Distances and inner products of the pivots. Vectors are divided by ``top``, so that squares stay in range."""

    def __init__(self, pivots: np.ndarray, top: float) -> None:
        self.top, self.pivots = top, pivots / top
        self.norms = (self.pivots**2).sum(1)
        self.size = np.sqrt(self.norms)
        self.dots = self.pivots @ self.pivots.T
        self.between = np.sqrt(np.maximum(self.norms[:, None] + self.norms - 2 * self.dots, 0))
        #: Rounding: distances come as roots of differences of squares, each of at most the width of a vector.
        self.slack = 1e-6 * pivots.shape[1]

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = v / self.top
        d = self.norms - 2 * x @ self.pivots.T
        cell = d.argmin(1)
        return cell.astype(np.int32), np.sqrt(np.maximum((x**2).sum(1) + d[np.arange(len(x)), cell], 0))


def celled(rows: DataFrame, geometry: Geometry, width: int, every: int, number: str) -> DataFrame:
    """id, cell, distance to its pivot (away), is_query and v of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cell, away = geometry.nearest(matrix(b.column(1), width))
                is_query = b.column(0).to_numpy() % every == 0
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), pa.array(away), pa.array(is_query), b.column(1)], ["id", "cell", "away", "is_query", "v"])

    return rows.mapInArrow(run, f"id long, cell int, away double, is_query boolean, v array<{number}>")


def bounds(geometry: Geometry, radius: dict[int, float], near: list[tuple[int, float]], k: int) -> dict[int, float]:
    """theta by query cell: the k best of all of its queries score at least that; ``near`` are (cell, distance to its pivot) of rows."""
    cell, e = np.array([c for c, _ in near], dtype=int), np.array([d for _, d in near])
    out = {}
    for i, a in radius.items():
        sure = np.sort(geometry.dots[i, cell] - (geometry.size[i] * e + a * geometry.size[cell] + a * e))[::-1]
        out[i] = float(sure[k - 1]) - geometry.slack if len(sure) >= k else -np.inf
    return out


def joined(between: np.ndarray, queries: dict[int, int], most: int) -> list[list[int]]:
    """Query cells in groups of about ``most`` queries: from cell to nearest cell, so that a group lies together."""
    left, out, room = set(queries), [], 0
    at = min(left)
    while left:
        left.discard(at)
        if not out or room < queries[at]:
            out.append([])
            room = most
        out[-1].append(at)
        room -= queries[at]
        if left:
            rest = np.array(sorted(left))
            at = int(rest[between[at, rest].argmin()])
    return out


def starts(geometry: Geometry, groups: list[list[int]], radius: dict[int, float], theta: dict[int, float]) -> np.ndarray:
    """By group and data cell, the distance to the pivot from which on rows are needed."""
    out = np.full((len(groups), len(geometry.size)), np.inf)
    for g, cells in enumerate(groups):
        for i in cells:
            a = radius[i]
            need = (theta[i] - geometry.dots[i] - a * geometry.size) / max(geometry.size[i] + a, 1e-12) - geometry.slack
            out[g] = np.minimum(out[g], need)
    return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers of any size."""
    whole = lambda x: np.array([int(y) for y in x.ravel()], dtype=object).reshape(x.shape)
    return whole(a) @ whole(b).T


def best(score: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of one query; ``ids`` ascend."""
    other = ids != own
    s, near = score[other], ids[other]
    if len(s) > k:
        # the k-th best score, then all above it and the smallest ids at it
        limit = np.partition(s, len(s) - k)[len(s) - k]
        above = np.flatnonzero(s > limit)
        at = np.concatenate([above, np.flatnonzero(s == limit)[: k - len(above)]])
        s, near = s[at], near[at]
    return s, near


def plan(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0, pivots: int = PIVOTS, block: int = BLOCK, query_block: int = QUERY_BLOCK):
    """The rows as they are sent to the groups, and how to solve a block; None if there is nothing to join."""
    rows = usable(vectors, id_col, vec_col, scale)
    largest = F.max(F.coalesce(F.array_max(F.transform("v", F.abs)), F.lit(0.0)))
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), largest.alias("top"), F.count_if(F.col("id") % every == 0).alias("nq")).first()
    if not facts.nq:
        return None
    width, top = max(facts.width, 1), max(facts.top, 1.0)
    same = rows.groupBy("id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(int(min(pivots, max(16, 4 * facts.n**0.5)))).select("v").collect()
    points = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        points[i, : len(r.v)] = r.v
    geometry = Geometry(np.unique(points, axis=0), top)
    # whole numbers below 2^24 are exact in half the bytes
    number = "float" if top < 1 << 24 else "double"
    cells, _ = stored(celled(rows.select("id", F.col("v").cast(f"array<{number}>").alias("v")), geometry, width, every, number), "cells")
    is_query = F.col("is_query")
    summary = cells.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(is_query).alias("nq"), F.max(F.when(is_query, F.col("away"))).alias("a"), F.max("away").alias("r")).collect()  # a row for each pivot
    order = Window.partitionBy("cell").orderBy("away")
    near = cells.select("cell", "away", F.row_number().over(order).alias("i")).where(F.col("i") <= k + same).collect()  # k + same for each pivot
    count, radius = {r.cell: r.nq for r in summary if r.nq}, {r.cell: r.a for r in summary if r.nq}
    # a query's own id may be among the rows that the bound counts
    theta = bounds(geometry, radius, [(r.cell, r.away) for r in near], k + same)
    groups = joined(geometry.between, count, query_block)
    least = starts(geometry, groups, radius, theta)
    data, reach = np.zeros(len(geometry.size), dtype=int), np.full(len(geometry.size), -1.0)
    for r in summary:
        data[r.cell], reach[r.cell] = r.n, r.r
    group_of = {c: g for g, own in enumerate(groups) for c in own}
    q_parts = [-(-sum(count[c] for c in own) // query_block) for own in groups]
    d_parts = [max(1, -(-int(data[reach >= least[g]].sum()) // block)) for g in range(len(groups))]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of data to its block of rows of each group that needs it, once for each block of queries there; a query to its block of queries, once
        for each block of rows."""

        def out(b: pa.RecordBatch, at: np.ndarray, g: int, q: np.ndarray, d: np.ndarray, key: np.ndarray | None) -> pa.RecordBatch:
            picked = b.take(pa.array(at))
            size = len(at)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(size, g, np.int32)), pa.array(q.astype(np.int32)), pa.array(d.astype(np.int32)), picked.column(0), pa.array(np.full(size, -1) if key is None else key), picked.column(4)],
                ["g", "q", "d", "id", "key", "v"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            cell, away, is_query, key = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 5))
            spread = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            owner = np.array([group_of[c] if q else -1 for c, q in zip(cell.tolist(), is_query, strict=True)])
            for g in range(len(groups)):
                at = np.flatnonzero(away >= least[g][cell])
                for part in range(q_parts[g] if len(at) else 0):
                    yield out(b, at, g, np.full(len(at), part), spread[at] % np.uint64(d_parts[g]), None)
                at = np.flatnonzero(owner == g)
                for part in range(d_parts[g] if len(at) else 0):
                    yield out(b, at, g, spread[at] % np.uint64(q_parts[g]), np.full(len(at), part), key[at])

    keyed = cells.select("id", "cell", "away", "is_query", "v", F.monotonically_increasing_id().alias("key"))
    sent = keyed.mapInArrow(dealt, f"g int, q int, d int, id long, key long, v array<{number}>")
    fits = top * top * width < 1 << 53

    def solve(table: pa.Table) -> pa.Table:
        ids, keys, v = table.column("id").to_numpy(), table.column("key").to_numpy(), matrix(table.column("v").combine_chunks(), width)
        q, d = np.flatnonzero(keys >= 0), np.flatnonzero(keys < 0)
        d = d[np.argsort(ids[d], kind="stable")]
        near, rows = ids[d], v[d]
        out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 4]
        for first in range(0, len(q) if len(d) else 0, AT_ONCE):
            some = q[first : first + AT_ONCE]
            score = v[some] @ rows.T if fits else np.clip(exact(v[some], rows), LONG.min, LONG.max).astype(np.int64)
            for i, own in zip(some, score, strict=True):
                s, found = best(own, near, ids[i], k)
                out.append((np.full(len(s), keys[i]), np.full(len(s), ids[i]), found, s.astype(np.int64)))
        return pa.table(dict(zip(("key", "query_id", "id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return sent, solve


def top_k(vectors: DataFrame, k: int = 20, **options) -> DataFrame:
    """query_id, rank, id, score of the k best rows for each row whose id is divisible by ``every``."""
    made = plan(vectors, k, **options)
    if made is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    sent, solve = made
    found = sent.groupBy("g", "q", "d").applyInArrow(solve, "key long, query_id long, id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * d.e[i])), 0) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
