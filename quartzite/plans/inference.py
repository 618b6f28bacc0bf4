"""Type inference for text columns: one job counts what parses as what, the driver decides, a projection applies.

Order: boolean, number, date and time. A column keeps its type unless the share of its values that parse reaches the threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.functions import numbers as N
from quartzite.plans.config import CleanOptions
from quartzite.plans.stats import aggregate, is_text, q

BIGGEST = float(2**63 - 1024)
#: Text columns with no more distinct values than this share of their rows are counted by value before they are parsed.
REPEATED = 0.1


@dataclass(frozen=True)
class Conversion:
    column: str
    target: str
    value: Column
    parsed: int
    unparsed: int


def candidates(c: Column, options: CleanOptions, weight: Column | None = None) -> dict[str, Column]:
    """What the values of a column parse as; each counts once, or as often as ``weight`` says."""
    count_if = F.count_if if weight is None else lambda x: F.coalesce(F.sum(F.when(x, weight)), F.lit(0))
    count = F.count if weight is None else lambda x: count_if(x.isNotNull())
    plain, formatted = N.plain_number(c), N.formatted_number(c, options.decimal, options.thousands)
    dated = c.rlike(N.DATEISH)
    first = F.regexp_extract(c, r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.][0-9]{4}", 1).try_cast("int")
    second = F.regexp_extract(c, r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.][0-9]{4}", 2).try_cast("int")
    noisy = c.rlike(f"[{N.CURRENCY}{options.thousands}\\s]") if options.decimal == "." else F.lit(True)
    return {
        "n": count(c),
        "bool": count(N.boolean(c)),
        "plain": count(plain),
        "formatted": count(formatted),
        "noisy": count_if(noisy),
        "zeros": count_if(N.leading_zero(c)),
        "plain_frac": count_if(plain % 1 != 0),
        "plain_max": F.max(F.abs(plain)),
        "formatted_frac": count_if(formatted % 1 != 0),
        "formatted_max": F.max(F.abs(formatted)),
        "dateish": count_if(dated),
        "day_votes": count_if(first.between(13, 31)),
        "month_votes": count_if(second.between(13, 31)),
        "iso": count(F.when(dated, N.timestamp(c, N.ISO_FORMATS))),
        "day_first": count(F.when(dated, N.timestamp(c, N.ISO_FORMATS + N.DAY_FIRST))),
        "month_first": count(F.when(dated, N.timestamp(c, N.ISO_FORMATS + N.MONTH_FIRST))),
    }


def decide(name: str, got: dict[str, object], options: CleanOptions) -> Conversion | None:
    c, n = q(name), got["n"]
    if not n:
        return None
    if got["bool"] == n:
        return Conversion(name, "boolean", N.boolean(c), n, 0)
    if not got["zeros"]:
        kind = "plain"
        if got["plain"] < options.numeric_threshold * n and got["noisy"]:
            kind = "formatted"
        if got[kind] and got[kind] >= options.numeric_threshold * n:
            value = N.plain_number(c) if kind == "plain" else N.formatted_number(c, options.decimal, options.thousands)
            whole = not got[f"{kind}_frac"] and got[f"{kind}_max"] < BIGGEST
            return Conversion(name, "bigint" if whole else "double", value.cast("bigint") if whole else value, got[kind], n - got[kind])
    if got["dateish"] >= 0.6 * n:
        day = got["day_votes"] > got["month_votes"]
        formats = N.ISO_FORMATS + (N.DAY_FIRST if day else N.MONTH_FIRST)
        parsed = got["day_first"] if day else got["month_first"]
        if parsed >= options.datetime_threshold * n:
            return Conversion(name, "timestamp_ntz", F.when(c.rlike(N.DATEISH), N.timestamp(c, formats)), parsed, n - parsed)
    return None


def suggest(df: DataFrame, options: CleanOptions, few: Collection[str] = (), repaired: Callable[[Column], Column] = lambda c: c) -> list[Conversion]:
    """Conversions for the text columns of a frame whose text is repaired, or to be repaired by ``repaired``; one job, and one more for
    the columns of ``few`` distinct values, whose values are counted first and parsed once each."""
    text = [f.name for f in df.schema if is_text(f.dataType)]
    each = [c for c in text if c not in few]
    flat = aggregate(df, {(c, k): v for c in each for k, v in candidates(repaired(q(c)), options).items()})
    got: dict[str, dict[str, object]] = {c: {} for c in text}
    for (c, k), v in flat.items():
        got[c][k] = v
    counted = [c for c in text if c in few]
    if counted:
        long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), q(c).alias("v")) for i, c in enumerate(counted)))).alias("x")).select("x.i", "x.v")
        sizes = long.groupBy("i", "v").agg(F.count(F.lit(1)).alias("size"))
        wanted = candidates(repaired(F.col("v")), options, F.col("size"))
        for row in sizes.groupBy("i").agg(*(v.alias(f"s_{k}") for k, v in wanted.items())).collect():  # a row for each column
            got[counted[row.i]] = {k: row[f"s_{k}"] for k in wanted}
    out = (decide(c, got[c], options) for c in text if got[c])
    return [x for x in out if x is not None]


def apply(df: DataFrame, conversions: list[Conversion]) -> DataFrame:
    by_name = {c.column: c.value for c in conversions}
    return df.select(*(by_name[c].alias(c) if c in by_name else q(c) for c in df.columns)) if by_name else df
