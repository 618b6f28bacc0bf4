"""Statistics of a frame in few jobs: every requested number of every column goes into one aggregate.

Exact quantiles of all columns come from histograms that close in on their ranks, never from a map of all values. Order over all rows
is cut into pieces of the order column's range.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Steps of a quantile's first histogram for each unit of log1p, steps of the later ones, and rows of a bracket that are counted by value.
STEPS, FINER, FEW = 1024, 65_536, 65_536
QUARTILES = (0.25, 0.5, 0.75)


def q(name: str) -> Column:
    """The column of a name, whatever is in the name."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_integer(t: T.DataType) -> bool:
    return isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_time(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def family(t: T.DataType) -> str:
    return "bool" if isinstance(t, T.BooleanType) else "int" if is_integer(t) else "float" if is_number(t) else "datetime" if is_time(t) else "string"


def without_nan(df: DataFrame) -> DataFrame:
    """NaN is a missing value like NULL."""
    if not any(isinstance(f.dataType, (T.DoubleType, T.FloatType)) for f in df.schema):
        return df
    return df.select(*(F.when(~F.isnan(q(f.name)), q(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else q(f.name) for f in df.schema))


def aggregate(df: DataFrame, wanted: dict[tuple[str, str], Column]) -> dict[tuple[str, str], object]:
    """All of ``wanted`` in one job; keys are (column, statistic)."""
    if not wanted:
        return {}
    keys = list(wanted)
    row: Row = df.agg(*(wanted[k].alias(f"s{i}") for i, k in enumerate(keys))).first()
    return dict(zip(keys, row, strict=True))


@dataclass
class ColumnStats:
    name: str
    dtype: T.DataType
    rows: int = 0
    n: int = 0
    distinct: int | None = None
    mean: float | None = None
    std: float | None = None
    std_pop: float | None = None
    skew: float | None = None
    min: object = None
    max: object = None
    q1: float | None = None
    median: float | None = None
    q3: float | None = None
    quantiles: dict[float, float] = field(default_factory=dict)
    mode: object = None
    mode_count: int = 0
    length: float | None = None
    spaces: float | None = None
    corr: dict[str, float] = field(default_factory=dict)

    @property
    def missing(self) -> int:
        return self.rows - self.n

    @property
    def ratio(self) -> float:
        return self.missing / self.rows if self.rows else 0.0

    @property
    def mode_ratio(self) -> float:
        return self.mode_count / self.n if self.n else 0.0


def orderable(t: T.DataType) -> bool:
    return is_text(t) or is_number(t) or is_time(t) or isinstance(t, T.BooleanType)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Kept on the executors while it is analysed, so that what it comes from is computed once."""
    level = df.storageLevel
    if level.useMemory or level.useDisk:
        yield df
        return
    df.persist()
    try:
        yield df
    finally:
        df.unpersist()


@dataclass
class Bracket:
    """Rows of a column that hold a rank: their least and largest value, how many there are, and how many are less."""

    low: float
    high: float
    n: int
    below: int = 0


def quantiles(df: DataFrame, wanted: dict[str, Collection[float]]) -> dict[str, dict[float, float]]:
    """Exact quantiles of numeric columns as ``percentile`` has them, with the same interpolation; columns without values have none.

    Every value is counted. A histogram on a logarithmic scale finds the bracket of each rank, histograms between a bracket's ends narrow it,
    and a bracket of few rows is counted by value: two to four jobs in most cases, in which only counts are shuffled.
    """
    columns = [c for c, at in wanted.items() if at]
    if not columns:
        return {}
    v, one = F.col("v"), F.count(F.lit(1)).alias("n")
    odd = F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    bucket = F.when(odd, F.when(v == F.lit(float("-inf")), -(2**40)).otherwise(F.when(F.isnan(v), 2**41).otherwise(2**40))).otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * STEPS)).cast("long")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), q(c).cast("double").alias("v")) for i, c in enumerate(columns)))).alias("x")).select("x.i", "x.v").where("v is not null")
    got = long.groupBy("i", bucket.alias("b")).agg(one, F.min("v").alias("low"), F.max("v").alias("high"))
    parts: dict[int, list[Bracket]] = {}
    for i, _, n, low, high in sorted(got.collect(), key=lambda r: (r.i, r.b)):
        parts.setdefault(i, []).append(Bracket(low, high, n))
    totals = {i: sum(x.n for x in p) for i, p in parts.items()}
    ends = {(i, p): (totals[i] - 1) * p for i in parts for p in wanted[columns[i]]}
    open_: dict[tuple[int, int], Bracket] = {}

    def place(i: int, ranks: Collection[int], brackets: list[Bracket], below: int) -> None:
        left = sorted(ranks)
        for x in brackets:
            x.below = below
            while left and left[0] < below + x.n:
                open_[i, left.pop(0)] = x
            below += x.n

    for i, p in parts.items():
        place(i, {r for (j, _), x in ends.items() if j == i for r in (math.floor(x), math.ceil(x))}, p, 0)
    done = lambda x: x.low == x.high or x.low != x.low
    while rest := {id(x): (i, x) for (i, _), x in open_.items() if not done(x)}:
        todo = list(rest.values())
        inside = [q(columns[i]).cast("double").between(x.low, x.high) for i, x in todo]
        step = [q(columns[i]).cast("double") if x.n <= FEW else F.least(F.floor((q(columns[i]).cast("double") - F.lit(x.low)) / F.lit(x.high - x.low) * F.lit(float(FINER))), F.lit(FINER)).cast("double") for i, x in todo]
        hits = F.filter(F.array(*(F.when(y, F.struct(F.lit(k).alias("k"), s.alias("b"), q(columns[i]).cast("double").alias("v"))) for k, ((i, _), y, s) in enumerate(zip(todo, inside, step, strict=True)))), lambda x: x.isNotNull())
        got = df.where(reduce(or_, inside)).select(F.explode(hits).alias("x")).groupBy("x.k", "x.b").agg(one, F.min("x.v").alias("low"), F.max("x.v").alias("high"))
        finer: dict[int, list[Bracket]] = {}
        for k, _, n, low, high in sorted(got.collect(), key=lambda r: (r.k, r.b)):
            finer.setdefault(k, []).append(Bracket(low, high, n))
        for k, (i, x) in enumerate(todo):
            place(i, [r for (j, r), y in open_.items() if y is x], finer[k], x.below)
    out: dict[str, dict[float, float]] = {}
    for (i, p), x in ends.items():
        lower, higher = open_[i, math.floor(x)].low, open_[i, math.ceil(x)].low
        out.setdefault(columns[i], {})[p] = lower if lower == higher or x == math.floor(x) else (math.ceil(x) - x) * lower + (x - math.floor(x)) * higher
    return out


def plain_text(t: T.DataType) -> bool:
    """Text of which equal values have equal characters."""
    return is_text(t) and "collate" not in t.simpleString()


def words(c: Column) -> Column:
    """Parts of a text between white space; its pattern is compiled once, that of ``split`` for every text."""
    return F.regexp_count(F.trim(c), F.lit("\\s+")) + 1


def describe(df: DataFrame, columns: Iterable[str] | None = None, modes: bool | Collection[str] = True, at: Collection[float] = QUARTILES) -> dict[str, ColumnStats]:
    """Statistics of the named columns: one job for moments, one for texts not counted by value, a few for the quantiles ``at`` of all numeric columns, one for the modes of each type.
    ``modes`` may name the columns whose modes and distinct values are counted."""
    chosen = [f for f in df.schema if columns is None or f.name in set(columns)]
    counted = [f for f in chosen if modes and orderable(f.dataType) and (modes is True or f.name in modes)]
    wanted: dict[tuple[str, str], Column] = {("", "rows"): F.count(F.lit(1))}
    apart: dict[tuple[str, str], Column] = {}
    for f in chosen:
        c = q(f.name)
        wanted[f.name, "n"] = F.count(c)
        if not orderable(f.dataType):
            continue
        if is_text(f.dataType):
            # least and largest texts would take the numbers' aggregate off its fast path
            if not (f in counted and plain_text(f.dataType)):
                apart |= {(f.name, "min"): F.min(c), (f.name, "max"): F.max(c), (f.name, "length"): F.avg(F.length(c)), (f.name, "spaces"): F.avg(words(c))}
            continue
        if not isinstance(f.dataType, T.BooleanType):
            wanted |= {(f.name, "min"): F.min(c), (f.name, "max"): F.max(c)}
        if is_number(f.dataType):
            d = c.cast("double")
            from quartzite.functions.numbers import sample_skewness

            wanted |= {(f.name, "mean"): F.avg(d), (f.name, "std"): F.stddev_samp(d), (f.name, "std_pop"): F.stddev_pop(d), (f.name, "skew"): sample_skewness(d)}
    got = aggregate(df, wanted) | aggregate(df, apart)
    out = {f.name: ColumnStats(f.name, f.dataType, rows=got["", "rows"]) for f in chosen}
    numeric = [f.name for f in chosen if is_number(f.dataType)]
    for c, found in quantiles(df, dict.fromkeys(numeric, at)).items():
        out[c].quantiles = found
        out[c].q1, out[c].median, out[c].q3 = (found.get(p) for p in QUARTILES)
    for (c, stat), v in got.items():
        if c:
            setattr(out[c], stat, v)
    texts: dict[str, tuple[int, int, str, str]] = {}
    for name, (value, count, distinct) in mode_table(df, counted, texts).items():
        out[name].mode, out[name].mode_count, out[name].distinct = value, count, distinct
    for name, (length, parts, least, largest) in texts.items():
        out[name].length, out[name].spaces, out[name].min, out[name].max = length / out[name].n, parts / out[name].n, least, largest
    return out


def mode_table(df: DataFrame, columns: list[T.StructField], texts: dict[str, tuple[int, int, str, str]] | None = None) -> dict[str, tuple[object, int, int]]:
    """Most frequent value (ties: the smallest), its count and the number of distinct values, for many columns in one job.

    Columns of one type are turned into (column, value) rows together, so their counts share one shuffle; counts are combined before it.
    ``texts`` gets the characters and words of all rows of a text column, its least and its largest value, taken once for each value.
    """
    out: dict[str, tuple[object, int, int]] = {}
    by_type: dict[str, list[str]] = {}
    for f in columns:
        by_type.setdefault(f.dataType.simpleString(), []).append(f.name)
    for names in by_type.values():
        long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), q(c).alias("v")) for i, c in enumerate(names)))).alias("x")).select("x.i", "x.v").where("v is not null")
        counts = long.groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
        sums = [F.sum(F.col("n") * x).alias(k) for k, x in (("length", F.length("v")), ("words", words(F.col("v"))))] + [F.min("v").alias("least"), F.max("v").alias("largest")] if texts is not None and plain_text(df.schema[names[0]].dataType) else []
        best = counts.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col("v"))).alias("top"), F.count(F.lit(1)).alias("distinct"), *sums).collect()  # a row for each column
        for r in best:
            out[names[r.i]] = (r.top.v, -r.top.minus, r.distinct)
            if sums:
                texts[names[r.i]] = (r.length, r.words, r.least, r.largest)
        for c in names:
            out.setdefault(c, (None, 0, 0))
    return out


def correlations(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], float]:
    """Absolute pairwise Pearson correlations, pairwise complete, in one job."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[:i]]
    got = aggregate(df, {p: F.corr(q(p[0]).cast("double"), q(p[1]).cast("double")) for p in pairs})
    return {p: abs(v) for p, v in got.items() if v is not None}


def with_row_id(df: DataFrame, order_by: str | None, name: str = "_row_id") -> DataFrame:
    """An explicit order: the given column, else the order of the scan."""
    return df.withColumn(name, q(order_by) if order_by else F.monotonically_increasing_id())


def in_order(order: str = "_row_id") -> Window:
    return Window.orderBy(order)


#: Rows of a piece, and the most pieces.
PIECE, PIECES = 250_000, 1000


def piece(df: DataFrame, order_by: str) -> Column:
    """Number of the piece of the order column's range that a row is in; NULLs, which come first, are piece -1. Two jobs.

    Equal values share a piece, so order over all rows is order within pieces and among them; only the balance depends on the bounds.
    """
    key = df.select(q(order_by).alias("k")).where("k is not null")
    n = min(PIECES, -(-key.count() // PIECE))
    bounds: list[object] = []
    if n > 1:
        parts = key.repartitionByRange(n, "k").select("k", F.spark_partition_id().alias("p"))
        bounds = sorted(r.k for r in parts.groupBy("p").agg(F.max("k").alias("k")).collect())[:-1]

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(q(order_by) <= F.lit(bounds[mid]), pick(low, mid)).otherwise(pick(mid + 1, high))

    return F.when(q(order_by).isNull(), F.lit(-1)).otherwise(pick(0, len(bounds)))
