"""Duplicate rows: whole rows, by a subset, keeping first, last, none, or an aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quartzite.plans.stats import is_number, q, with_row_id

#: Rows of fewer columns are not worth a hash.
WIDE = 4


def checked_subset(df: DataFrame, subset) -> list[str]:
    missing = [c for c in subset if c not in df.columns]
    if missing:
        raise ValueError(f"duplicate_subset has columns that are not there: {', '.join(missing)}")
    return list(subset)


def deduplicate(df: DataFrame, subset=None, keep: str = "first", order_by: str | None = None) -> DataFrame:
    """NULLs are equal. Which whole-row copy stays cannot be seen, so those need no order and are combined before the shuffle."""
    if not subset:
        if keep in ("first", "last", "aggregate"):
            return df.dropDuplicates()
        return df.groupBy(*(q(c) for c in df.columns)).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    keys = checked_subset(df, subset)
    rows = with_row_id(df, order_by)
    rest = [f for f in df.schema if f.name not in keys]
    order = F.col("_row_id")
    if keep == "aggregate":
        values = [F.avg(q(f.name)).alias(f.name) if is_number(f.dataType) else F.min_by(q(f.name), F.when(q(f.name).isNotNull(), order)).alias(f.name) for f in rest]
        return rows.groupBy(*(q(c) for c in keys)).agg(*values).select(*(q(c) for c in df.columns)) if values else rows.select(*(q(c) for c in keys)).dropDuplicates()
    if keep in ("first", "last"):
        # an aggregate, not a window: partial results are combined before the shuffle and hot keys cost no sort
        pick = F.min_by if keep == "first" else F.max_by
        whole = F.struct(*(q(c) for c in df.columns))
        return rows.groupBy(*(q(c).alias(f"_k{i}") for i, c in enumerate(keys))).agg(pick(whole, order).alias("_row")).select("_row.*")
    w = Window.partitionBy(*(q(c) for c in keys))
    return rows.withColumn("_n", F.count(F.lit(1)).over(w)).where("_n = 1").select(*(q(c) for c in df.columns))


def may_repeat(df: DataFrame, columns: list[str]) -> bool:
    """False if no two rows agree on ``columns``, by a hash of each row: equal rows have equal hashes, and only those are shuffled."""
    if len(columns) < WIDE or "collate" in df.schema.simpleString():
        return True
    hashes = df.groupBy(row_hash(columns).alias("_h")).agg(F.count(F.lit(1)).alias("_n"))
    return (hashes.agg(F.max("_n")).first()[0] or 0) > 1


def duplicate_rows(df: DataFrame) -> int:
    """Rows beyond the first of each group of equal rows, NULLs equal."""
    if not may_repeat(df, df.columns):
        return 0
    groups = df.groupBy(*(q(c) for c in df.columns)).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0))).first()[0]


def row_hash(columns: list[str]) -> Column:
    return F.xxhash64(*(q(c) for c in columns))


def recent_window_dedup(batch: DataFrame, seen: DataFrame | None, columns: list[str] | None = None) -> DataFrame:
    """Rows of a batch whose hash is not among ``seen`` (column h)."""
    fresh = batch.withColumn("_h", row_hash(columns or batch.columns)).dropDuplicates(["_h"])
    return (fresh if seen is None else fresh.join(seen, fresh._h == seen.h, "left_anti")).drop("_h")
