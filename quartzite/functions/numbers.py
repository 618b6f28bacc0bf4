"""Parsing of numbers, booleans and dates from text, and fences; all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PLAIN = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
TRUE, FALSE = ("true", "t", "yes", "y"), ("false", "f", "no", "n")
CURRENCY = "$€£₹"
#: Shapes of dates with a year first or last; the ladder of formats goes from unambiguous to ambiguous ones.
DATEISH = r"^[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?\z"
ISO_FORMATS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy-M-d H:m", "yyyy-M-d H:m:s", "yyyy-M-d'T'H:m:s", "yyyy/M/d H:m:s")
DAY_FIRST = ("d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yyyy H:m", "d/M/yyyy H:m:s")
MONTH_FIRST = ("M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "M/d/yyyy H:m", "M/d/yyyy H:m:s")


def plain_number(c: Column) -> Column:
    """Double of a plain number, else NULL; suffixes and spellings that only Java knows are none."""
    return F.when(c.rlike(PLAIN), c.try_cast("double"))


def formatted_number(c: Column, decimal: str = ".", thousands: str = ",") -> Column:
    """Also currency signs, grouped thousands and another decimal separator."""
    d, t = (f"\\{x}" for x in (decimal, thousands))
    shape = f"^[+-]?[{CURRENCY}]?\\s?[+-]?(?:[0-9]{{1,3}}(?:{t}[0-9]{{3}})+|[0-9]+)(?:{d}[0-9]+)?\\s?[{CURRENCY}]?\\z"
    bare = F.replace(F.regexp_replace(c, f"[{CURRENCY}\\s{t}]", ""), F.lit(decimal), F.lit("."))
    fits = c.rlike(shape) if decimal != "." else c.rlike(shape) | c.rlike(PLAIN)
    return F.when(fits, bare.try_cast("double"))


def leading_zero(c: Column) -> Column:
    """Codes such as 007, which numbers would spoil."""
    return c.rlike(r"^\s*[+-]?0[0-9]")


def boolean(c: Column) -> Column:
    word = F.lower(c)
    return F.when(word.isin(*TRUE), True).when(word.isin(*FALSE), False)


def timestamp(c: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats)).cast("timestamp_ntz")


def iqr_fences(q1: float | None, q3: float | None, factor: float = 1.5) -> tuple[float, float] | None:
    if q1 is None or q3 is None or q3 <= q1:
        return None
    return q1 - factor * (q3 - q1), q3 + factor * (q3 - q1)


def zscore_fences(mean: float | None, std: float | None, factor: float = 3.0) -> tuple[float, float] | None:
    if mean is None or not std:
        return None
    return mean - factor * std, mean + factor * std


def clip(c: Column, low: float, high: float) -> Column:
    """NULL stays NULL: least and greatest alone would make a fence of it."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def outside(c: Column, low: float, high: float) -> Column:
    return F.coalesce((c < low) | (c > high), F.lit(False))


def sample_skewness(c: Column) -> Column:
    """Bias-corrected; Spark's own is the population's."""
    n = F.count(c)
    return F.when(n >= 3, F.skewness(c) * F.sqrt(n * (n - 1.0)) / (n - 2.0))
