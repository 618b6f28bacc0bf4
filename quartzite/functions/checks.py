"""Checks of domain rules: each gives a boolean column that is true where a row violates the rule.

A value is present where it is not NULL; most checks look at present values only. ``as_of`` is the date that counts as today.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from quartzite.functions.numbers import plain_number

ISO_DATE, ISO_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?\z"


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def number(c: Column) -> Column:
    return plain_number(c.cast("string"))


def any_of(checks: list[Column]) -> Column:
    out = checks[0]
    for c in checks[1:]:
        out = out | c
    return sure(out)


def not_null(*cs: Column) -> Column:
    return any_of([c.isNull() for c in cs])


def regex(pattern: str, *cs: Column) -> Column:
    return any_of([c.isNotNull() & ~c.cast("string").rlike(f"^(?:{pattern})\\z") for c in cs])


def enum(values, casefold: bool, *cs: Column) -> Column:
    ok = lambda c: F.lower(c.cast("string")).isin([str(v).lower() for v in values]) if casefold else c.cast("string").isin([str(v) for v in values])
    return any_of([c.isNotNull() & ~ok(c) for c in cs])


def in_range(low, high, *cs: Column) -> Column:
    out = []
    for c in cs:
        v = number(c)
        bad = v.isNull()
        if low is not None:
            bad = bad | (v < low)
        if high is not None:
            bad = bad | (v > high)
        out.append(c.isNotNull() & bad)
    return any_of(out)


def unique(*cs: Column) -> Column:
    """Every member of a group of equal present keys."""
    return sure(F.count(F.lit(1)).over(Window.partitionBy(*cs)) > 1) & ~not_null(*cs)


def repeated(order: str, *cs: Column) -> Column:
    """Second and later rows of a key."""
    return sure(F.row_number().over(Window.partitionBy(*cs).orderBy(order)) > 1) & ~not_null(*cs)


def iso_date(*cs: Column) -> Column:
    return any_of([c.isNotNull() & ~sure(c.cast("string").rlike(ISO_DATE) & F.try_to_timestamp(c.cast("string"), F.lit("yyyy-MM-dd")).isNotNull()) for c in cs])


def iso_datetime(*cs: Column) -> Column:
    return any_of([c.isNotNull() & ~sure(c.cast("string").rlike(ISO_TIME) & F.try_to_timestamp(F.substring(c.cast("string"), 1, 10), F.lit("yyyy-MM-dd")).isNotNull()) for c in cs])


def partial_date(*cs: Column) -> Column:
    return any_of([c.cast("string").rlike(r"^[0-9]{4}(?:-(?:0[1-9]|1[0-2]))?\z") for c in cs])


def fhir_date(*cs: Column) -> Column:
    return any_of([c.isNotNull() & iso_date(c) & ~partial_date(c) for c in cs])


def day(c: Column) -> Column:
    return F.try_to_timestamp(F.substring(c.cast("string"), 1, 10), F.lit("yyyy-MM-dd")).cast("date")


def not_future(as_of: Column, *cs: Column) -> Column:
    return any_of([day(c) > as_of for c in cs])


def numeric(*cs: Column) -> Column:
    return any_of([c.isNotNull() & number(c).isNull() for c in cs])


def nonneg(*cs: Column) -> Column:
    return any_of([number(c) < 0 for c in cs])


def nonneg_number(*cs: Column) -> Column:
    return any_of([c.isNotNull() & ~sure(number(c) >= 0) for c in cs])


def positive(*cs: Column) -> Column:
    return any_of([c.isNotNull() & ~sure(number(c) > 0) for c in cs])


def positive_integer(*cs: Column) -> Column:
    return any_of([c.isNotNull() & ~sure((number(c) > 0) & (number(c) % 1 == 0)) for c in cs])


def two_decimals(*cs: Column) -> Column:
    return any_of([c.isNotNull() & ~sure((number(c) >= 0) & (F.abs(number(c) * 100 - F.round(number(c) * 100)) <= 1e-6)) for c in cs])


def both_present(a: Column, b: Column) -> Column:
    return a.isNull() != b.isNull()


def requires(a: Column, b: Column | None) -> Column:
    return a.isNotNull() & (F.lit(True) if b is None else b.isNull())


def requires_when(a: Column, values, b: Column | None) -> Column:
    return sure(F.lower(a.cast("string")).isin([str(v).lower() for v in values])) & (F.lit(True) if b is None else b.isNull())


def at_least_one(*cs: Column) -> Column:
    return F.coalesce(*(c.cast("string") for c in cs)).isNull()


def date_order(later: Column, earlier: Column) -> Column:
    return sure(day(later) < day(earlier))


def balanced(key: Column, debit: Column, credit: Column, tolerance: float) -> Column:
    """Sums per key differ; rows without key are exempt. Sums in cents, so that no rounding adds up."""
    w = Window.partitionBy(key)
    gap = F.abs(F.sum(F.round(F.coalesce(number(debit), F.lit(0.0)) - F.coalesce(number(credit), F.lit(0.0)), 6)).over(w))
    return sure(key.isNotNull() & (gap > tolerance + 1e-9))


def monotonic(key: Column, value: Column, order: str) -> Column:
    """Not above the last present value before it in its group."""
    w = Window.partitionBy(key).orderBy(order)
    before = F.last(number(value), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return sure(number(value) <= before)


def clock_seconds(c: Column) -> Column:
    """Seconds of H:MM:SS, hours beyond 23 too."""
    ok = c.rlike(r"^[0-9]{1,3}:[0-5][0-9]:[0-5][0-9]\z")
    parts = F.split(c, ":")
    return F.when(ok, F.get(parts, F.lit(0)).try_cast("int") * 3600 + F.get(parts, F.lit(1)).try_cast("int") * 60 + F.get(parts, F.lit(2)).try_cast("int"))


def mod37_2(body: Column) -> Column:
    """Check character of ISO 7064 MOD 37,2 for a body of digits and capitals."""
    alphabet = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*"
    value = F.aggregate(F.filter(F.split(body, ""), lambda x: x != ""), F.lit(0), lambda acc, ch: ((acc + F.instr(F.lit(alphabet), ch) - 1) * 2) % 37)
    return F.substring(F.lit(alphabet), (38 - value) % 37 + 1, F.lit(1))
