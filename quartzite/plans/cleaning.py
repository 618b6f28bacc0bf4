"""The default clean: analyse in a few fused jobs, decide on the driver, apply as one lazy plan.

Stages: names, text repair, empty columns and rows, types, constant columns, duplicates, missing values, outliers, memory. Decisions need
only aggregates; the returned frame is a plan over the input that has not run yet.
"""

from __future__ import annotations

from contextlib import ExitStack
from copy import deepcopy
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quartzite.functions import numbers as N
from quartzite.functions import text as X
from quartzite.operators.dedup import deduplicate, may_repeat
from quartzite.plans import inference
from quartzite.plans.config import CleanOptions
from quartzite.plans.report import Report
from quartzite.plans.roles import role, sensitive
from quartzite.plans.stats import ColumnStats, aggregate, correlations, describe, held, is_integer, is_number, is_text, is_time, orderable, piece, q, without_nan

SMALL, PROBES, INFORMATIVE = 30, 3, 0.5


@dataclass(frozen=True)
class Choice:
    """One decision about a column, as a plan shows it."""

    column: str
    step: str
    action: str
    role: str
    band: str
    rationale: str
    risk: str = "low"
    confidence: float = 1.0
    value: object = None


def band(ratio: float, o: CleanOptions) -> str:
    return "low" if ratio <= o.missing_threshold_low else "medium" if ratio <= o.missing_threshold_medium else "high" if ratio <= o.missing_threshold_high else "extreme"


# --- repair -------------------------------------------------------------------------------------------------------------


def repair(df: DataFrame, o: CleanOptions, report: Report, hold: ExitStack | None = None) -> DataFrame:
    """Names, text, empty columns and rows, types, constant columns, duplicates. ``hold`` may keep rows without duplicates for the caller."""
    df = without_nan(df)
    if o.column_names:
        names = X.clean_names(df.columns)
        changed = sum(a != b for a, b in zip(df.columns, names, strict=True))
        if changed:
            report.add("column_names", None, changed, "renamed " + ", ".join(f"{a!r} to {b!r}" for a, b in zip(df.columns, names, strict=True) if a != b))
        df = df.toDF(*names)
    text = [f.name for f in df.schema if is_text(f.dataType)]
    repaired = [X.repaired(q(c), o.strip_whitespace, o.normalize_sentinels, o.extra_sentinels).alias(c) if c in text else q(c) for c in df.columns]
    fixed = df.select(*repaired)
    # what is counted of a text is made once a row, in a projection
    counted = df.select(*(x for i, c in enumerate(df.columns) for x in ((repaired[i].alias(f"new{i}"), (X.strip(q(c)) != q(c)).alias(f"strip{i}"), q(c).isNotNull().alias(f"was{i}")) if c in text else (q(c).alias(f"new{i}"),))))
    wanted: dict[tuple[str, str], Column] = {("", "rows"): F.count(F.lit(1))}
    for i, c in enumerate(df.columns):
        new = F.col(f"new{i}")
        wanted[c, "n"] = F.count(new)
        if c in text:
            wanted[c, "strip"] = F.count_if(F.col(f"strip{i}")) if o.strip_whitespace else F.lit(0)
            wanted[c, "sentinel"] = F.count_if(F.col(f"was{i}") & new.isNull())
            if o.fix_dtypes:
                wanted[c, "distinct"] = F.approx_count_distinct(new)
    got = aggregate(counted, wanted)
    rows = report.rows_before = got["", "rows"]
    report.columns_before = len(df.columns)
    for c in text:
        if got[c, "strip"]:
            report.add("strip_whitespace", c, got[c, "strip"], "white space at the ends removed")
        if got[c, "sentinel"]:
            report.add("normalize_sentinels", c, got[c, "sentinel"], "placeholders set missing")
    if o.drop_empty_columns and rows:
        empty = [c for c in df.columns if not got[c, "n"]]
        if empty and len(empty) < len(df.columns):
            fixed = fixed.drop(*empty)
            for c in empty:
                report.add("drop_empty_columns", c, 1, "column without values dropped")
    if o.drop_empty_rows:
        some = F.greatest(*(q(c).isNotNull() for c in fixed.columns), F.lit(False))
        full = fixed.where(some)
        if all(got[c, "n"] < rows for c in fixed.columns):
            gone = rows - full.count()
            rows -= gone
            if gone:
                report.add("drop_empty_rows", None, gone, "rows without values dropped")
        fixed = full
    if o.fix_dtypes:
        conversions = inference.suggest(fixed, o, [c for c in text if got[c, "distinct"] <= inference.REPEATED * got[c, "n"]])
        for x in conversions:
            report.add("fix_dtypes", x.column, x.parsed + x.unparsed, f"converted to {x.target}" + (f" ({x.unparsed} unparseable set missing)" if x.unparsed else ""), risk="medium" if x.unparsed else "low")
        fixed = inference.apply(fixed, conversions)
    if o.drop_constant_columns:
        able = [f.name for f in fixed.schema if orderable(f.dataType)]
        spread = aggregate(fixed, {("", "rows"): F.count(F.lit(1)), **{(c, k): v for c in able for k, v in (("n", F.count(q(c))), ("same", F.min(q(c)) == F.max(q(c))))}})
        for c in able:
            n = spread[c, "n"]
            if spread["", "rows"] >= 2 and (not n or (n == spread["", "rows"] and spread[c, "same"])):
                fixed = fixed.drop(c)
                report.add("drop_constant_columns", c, 1, "constant column dropped")
    if o.drop_duplicates:
        fixed = drop_duplicates(fixed, o, report, rows, hold)
    return fixed


def drop_duplicates(df: DataFrame, o: CleanOptions, report: Report, rows: int, hold: ExitStack | None = None) -> DataFrame:
    """``rows`` are those of the frame. With ``hold``, whole rows without duplicates are made once, counted, and kept if there are fewer."""
    if any(isinstance(f.dataType, (T.MapType, T.VariantType)) for f in df.schema):
        report.add("drop_duplicates", None, 0, "skipped: a column cannot be compared")
        return df
    if o.time_index and not o.allow_timeseries_duplicates:
        report.warnings.append("duplicates of a time-indexed frame are kept")
        return df
    out = deduplicate(df, o.duplicate_subset, o.duplicate_keep, o.order_by)
    if o.duplicate_keep in ("first", "last"):
        if not may_repeat(df, list(o.duplicate_subset or df.columns)):
            return df
        if hold is not None and not o.duplicate_subset:
            with ExitStack() as own:
                own.enter_context(held(out))
                before, after = rows, out.count()
                if after < before:
                    hold.enter_context(own.pop_all())
        else:
            sizes = df.groupBy(*(q(c) for c in o.duplicate_subset or df.columns)).agg(F.count(F.lit(1)).alias("size"))
            got = aggregate(sizes, {("", "before"): F.coalesce(F.sum("size"), F.lit(0)), ("", "after"): F.count(F.lit(1))})
            before, after = got["", "before"], got["", "after"]
    else:
        before, after = df.count(), out.count()
    if before == after and o.duplicate_keep in ("first", "last"):
        return df
    if before > after:
        report.add("drop_duplicates", None, before - after, f"{before - after} duplicate rows removed ({100 * (before - after) / before:.1f} %)")
        if (before - after) / before > o.duplicate_threshold:
            report.warnings.append(f"{100 * (before - after) / before:.1f} % of the rows are duplicates: check how the data was collected")
    return out


# --- missing values -----------------------------------------------------------------------------------------------------


def informative(df: DataFrame, stats: dict[str, ColumnStats]) -> set[str]:
    """Columns whose missing cells go along with other values of the first numeric columns; one job for all."""
    rows = next((s.rows for s in stats.values()), 0)
    probes = [c for c, s in stats.items() if is_number(s.dtype)][: PROBES + 1]
    wanted = {}
    for c, s in stats.items():
        if rows < SMALL or s.missing < 10 or s.n < 10:
            continue
        for p in [x for x in probes if x != c][:PROBES]:
            v = q(p).cast("double")
            for side, there in (("gone", q(c).isNull()), ("here", q(c).isNotNull())):
                wanted[c, f"{p}|{side}"] = F.struct(F.avg(F.when(there, v)).alias("m"), F.var_samp(F.when(there, v)).alias("v"), F.count(F.when(there, v)).alias("n"))
    got, out = aggregate(df, wanted), set()
    for (c, key), a in got.items():
        p, side = key.rsplit("|", 1)
        b = got[c, f"{p}|here"]
        if side == "gone" and a.n >= 10 and b.n >= 10 and a.v is not None and b.v is not None:
            spread = (((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2)) ** 0.5
            if spread > 0 and abs(a.m - b.m) / spread >= INFORMATIVE:
                out.add(c)
    return out


def has_outliers(s: ColumnStats) -> bool:
    f = N.iqr_fences(s.q1, s.q3)
    return f is not None and (s.min < f[0] or s.max > f[1])


def choose_missing(s: ColumnStats, r: str, ordered: bool, tells: bool, rows: int, o: CleanOptions) -> Choice:
    b = band(s.ratio, o)
    make = lambda action, why, **more: Choice(s.name, "missing", action, r, b, why, **more)
    if r in ("target", "id", "text"):
        return make("preserve", f"{r} columns are never filled")
    if rows < SMALL and b != "low":
        return make("preserve", "too few rows to judge", risk="medium", confidence=0.5)
    if b in ("high", "extreme"):
        if o.strategy == "aggressive" and s.name not in o.preserve_columns and not tells:
            return make("drop_column", f"{100 * s.ratio:.0f} % missing", risk="high", confidence=0.7)
        return make("preserve", f"{100 * s.ratio:.0f} % missing: filling would invent most of the column", risk="medium", confidence=0.6)
    if r == "datetime":
        return make("ordered_fill", "values rise or fall with the rows") if ordered else make("preserve", "not in order, no honest fill")
    if r == "boolean":
        return make("mode", "most frequent value", value=s.mode) if b == "low" else make("preserve", "too many missing for the most frequent value", confidence=0.6)
    if r == "numeric":
        if b == "low" and abs(s.skew or 0) < 0.5 and not has_outliers(s):
            return make("mean", "near-symmetric without outliers", value=s.mean, confidence=0.9)
        return make("median", "skewed, with outliers or many missing", value=s.median, confidence=0.85 if b == "low" else 0.7)
    least, other = (0.5, "Unknown") if b == "low" else (0.6, "Missing")
    if s.mode_ratio >= least:
        return make("mode", f"one value makes {100 * s.mode_ratio:.0f} %", value=s.mode, confidence=0.8)
    return make("constant", "no value dominates", value=other, confidence=0.7)


def time_order(df: DataFrame, columns: list[str], order_by: str | None) -> dict[str, bool]:
    """Whether the present values of a column never fall or never rise along ``order_by``; without one nothing is known to be in order."""
    if not columns or not order_by:
        return dict.fromkeys(columns, False)
    # within pieces by a window, from piece to piece by their first and last rows
    rows = df.select(q(order_by).alias("_key"), piece(df, order_by).alias("_piece"), *(q(c).alias(f"_c{i}") for i, c in enumerate(columns)))
    w, n = Window.partitionBy("_piece").orderBy("_key"), range(len(columns))
    inside = rows.select(*(F.col(f"_c{i}").alias(f"_a{i}") for i in n), *(F.lag(f"_c{i}").over(w).alias(f"_p{i}") for i in n))
    ends = rows.groupBy("_piece").agg(*(F.min_by(f"_c{i}", "_key").alias(f"_a{i}") for i in n), *(F.when(F.max("_key").isNull(), F.last(f"_c{i}")).otherwise(F.max_by(f"_c{i}", "_key")).alias(f"_z{i}") for i in n))
    between = ends.select(*(f"_a{i}" for i in n), *(F.lag(f"_z{i}").over(Window.orderBy("_piece")).alias(f"_p{i}") for i in n))
    wanted = {(c, k): F.coalesce(F.bool_and(op(F.col(f"_a{i}"), F.col(f"_p{i}"))), F.lit(True)) for i, c in enumerate(columns) for k, op in (("up", lambda a, b: a >= b), ("down", lambda a, b: a <= b))}
    x, y = aggregate(inside, wanted), aggregate(between, wanted)
    return {c: any(x[c, k] and y[c, k] for k in ("up", "down")) for c in columns}


def ordered_carry(df: DataFrame, columns: list[str], order_by: str) -> DataFrame:
    """The frame with columns ``_piece``, and ``_before<i>`` and ``_first<i>`` of each of ``columns``: its last value in the pieces before, and its first of all."""
    rows, n = df.withColumn("_piece", piece(df, order_by)), range(len(columns))
    key = q(order_by)
    some = [F.when(q(c).isNotNull(), key) for c in columns]
    # rows without a key come first, in any order among each other
    ends = rows.groupBy("_piece").agg(*(F.coalesce(F.min_by(q(c), some[i]), F.first(q(c), True)).alias(f"_a{i}") for i, c in enumerate(columns)), *(F.coalesce(F.max_by(q(c), some[i]), F.last(q(c), True)).alias(f"_z{i}") for i, c in enumerate(columns)))
    w = Window.orderBy("_piece")  # a row for each piece
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carry = ends.select("_piece", *(F.last(f"_z{i}", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_before{i}") for i in n), *(F.first(f"_a{i}", True).over(whole).alias(f"_first{i}") for i in n))
    return rows.join(F.broadcast(carry), "_piece", "left")


def fill(df: DataFrame, choices: list[Choice], marked: set[str], o: CleanOptions) -> DataFrame:
    """All fills in one projection; ordered ones go piece by piece."""
    names = df.columns
    ordered = [c.column for c in choices if c.action == "ordered_fill"]
    if ordered:
        df, w = ordered_carry(df, ordered, o.order_by or o.time_index), Window.partitionBy("_piece").orderBy(q(o.order_by or o.time_index)).rowsBetween(Window.unboundedPreceding, 0)
    by_name = {c.column: c for c in choices}
    out: list[Column] = []
    for f in (df.schema[c] for c in names):
        ch, c = by_name.get(f.name), q(f.name)
        if ch is None or ch.action == "preserve":
            out.append(c)
        elif ch.action == "drop_column":
            continue
        elif ch.action == "ordered_fill":
            i = ordered.index(f.name)
            out.append(F.coalesce(c, F.last(c, True).over(w), F.col(f"_before{i}"), F.col(f"_first{i}")).alias(f.name))
        else:
            value = ch.value
            if is_integer(f.dataType) and isinstance(value, float) and not value.is_integer():
                c = c.cast("double")
            kind = f.dataType if not isinstance(value, float) or not is_integer(f.dataType) or value.is_integer() else T.DoubleType()
            out.append(F.coalesce(c, F.lit(value).cast(kind)).alias(f.name))
    flags = [q(c).isNull().alias(f"{c}_was_missing") for c in names if c in marked and f"{c}_was_missing" not in names]
    return df.select(*out, *flags)


# --- outliers -----------------------------------------------------------------------------------------------------------


def fences(df: DataFrame, stats: dict[str, ColumnStats], method: str, factor: float | None) -> dict[str, tuple[float, float, str]]:
    """(low, high, method) for each numeric column; ``auto`` takes z-scores where the bulk is symmetric. At most one job."""
    bulk = {}
    if method == "auto":
        wide = {c: N.iqr_fences(s.q1, s.q3, 3.0) for c, s in stats.items()}
        bulk = aggregate(df, {(c, "skew"): N.sample_skewness(F.when(q(c).cast("double").between(*f), q(c).cast("double"))) for c, f in wide.items() if f})
    out = {}
    for c, s in stats.items():
        # no isolation forest without its library: the quartile rule stands in, and the label says so
        how = ("zscore" if abs(bulk.get((c, "skew")) or 0) < 0.5 else "iqr") if method == "auto" else "iqr" if method == "isolation_forest" else method
        f = N.zscore_fences(s.mean, s.std, factor or 3.0) if how == "zscore" else N.iqr_fences(s.q1, s.q3, factor or 1.5)
        if f:
            low, high = f
            if is_integer(s.dtype):
                import math

                low, high = float(math.floor(low)), float(math.ceil(high))
            out[c] = (low, high, how)
    return out


def choose_outliers(s: ColumnStats, r: str, share: float, o: CleanOptions) -> str:
    if r in ("target", "id") or sensitive(s.name) or s.name in o.preserve_columns or o.outlier_action is None:
        return "preserve"
    if o.outlier_action != "auto":
        return o.outlier_action
    return "flag" if share > 0.15 or o.strategy != "aggressive" else "cap"


# --- the clean ----------------------------------------------------------------------------------------------------------


def free_name(name: str, taken: list[str]) -> str:
    out, k = name, 2
    while out in taken:
        out, k = f"{name}_{k}", k + 1
    return out


def decide_missing(df: DataFrame, o: CleanOptions, stats: dict[str, ColumnStats] | None = None) -> tuple[dict[str, ColumnStats], dict[str, str], list[Choice], set[str]]:
    # of other columns neither the role nor the fill asks for modes and distinct values
    stats = stats or describe(df, modes=[f.name for f in df.schema if is_text(f.dataType) or is_integer(f.dataType) or isinstance(f.dataType, T.BooleanType)])
    roles = {c: role(s, o) for c, s in stats.items()}
    gaps = {c: s for c, s in stats.items() if s.missing}
    tells = informative(df, {**gaps, **{c: s for c, s in stats.items() if is_number(s.dtype)}}) if gaps else set()
    order = time_order(df, [c for c in gaps if is_time(stats[c].dtype)], o.order_by or o.time_index)
    rows = next((s.rows for s in stats.values()), 0)
    choices = [choose_missing(s, roles[c], order.get(c, False), c in tells, rows, o) for c, s in gaps.items()]
    return stats, roles, choices, tells


def clean(df: DataFrame, options: CleanOptions | None = None, **given) -> tuple[DataFrame, Report]:
    """The cleaned frame and the report of what was done to it, and why."""
    o = CleanOptions.of(options, **given)
    report = Report()
    if o.strategy == "conservative" and not (o.impute or o.outliers or o.optimize_memory):
        base = repair(df, o, report)
        report.columns_after = len(base.columns)
        return base, report
    with ExitStack() as hold:
        return judged(hold.enter_context(held(repair(df, o, report, hold))), o, report)


def judged(out: DataFrame, o: CleanOptions, report: Report, stats: dict[str, ColumnStats] | None = None) -> tuple[DataFrame, Report]:
    """What follows the repair: missing values, outliers, memory. ``stats`` are those of the repaired frame, if known."""
    if o.strategy != "conservative" and (not o.impute or not o.outliers):
        stats, roles, choices, tells = decide_missing(out, o, stats)
        same = stats
        if not o.impute:
            marked = {c.column for c in choices if c.action not in ("preserve", "drop_column") and (o.missing_indicators is True or (o.missing_indicators == "auto" and c.column in tells))}
            for c in choices:
                report.add("missing_values", c.column, stats[c.column].missing, f"{c.action}" + (f" {c.value!r}" if c.value is not None else ""), rationale=c.rationale, risk=c.risk, confidence=c.confidence, model_id=c.action)
            out = fill(out, choices, marked, o)
            same = unfilled(stats, choices)
        if not o.outliers:
            out = engine_outliers(out, roles, o, report, same)
    if o.impute:
        out = impute(out, o.impute, report=report)
    if o.outliers:
        out = handle_outliers(out, o.outliers, o.outlier_method, o.outlier_factor, report=report)
    if o.optimize_memory:
        out = optimize_memory(out, o, report)
    report.columns_after = len(out.columns)
    return out, report


def unfilled(stats: dict[str, ColumnStats], choices: list[Choice]) -> dict[str, ColumnStats]:
    """Statistics of the columns that ``fill`` leaves as they are."""
    filled = {c.column for c in choices if c.action != "preserve"}
    return {c: s for c, s in stats.items() if c not in filled}


def engine_outliers(df: DataFrame, roles: dict[str, str], o: CleanOptions, report: Report, known: dict[str, ColumnStats] | None = None) -> DataFrame:
    """``known`` holds statistics of columns of this frame that are computed already."""
    known, names = known or {}, [f.name for f in df.schema if is_number(f.dataType)]
    fresh = [c for c in names if c not in known]
    stats = known | (describe(df, fresh, modes=False) if fresh else {})
    numeric = {c: stats[c] for c in names if stats[c].n >= 4}
    bounds = fences(df, numeric, o.outlier_method, o.outlier_factor)
    hits = aggregate(df, {(c, "out"): F.count_if(N.outside(q(c), lo, hi)) for c, (lo, hi, _) in bounds.items()})
    project, flags, remove = {}, [], None
    for c, (lo, hi, how) in bounds.items():
        n = hits[c, "out"]
        if not n:
            continue
        share = n / numeric[c].n
        action = choose_outliers(numeric[c], roles.get(c, "numeric"), share, o)
        confidence = 0.85 if share <= 0.02 else 0.7 if share <= 0.10 else 0.5
        report.add("outliers", c, n, f"{action} ({how}, {lo:.6g} to {hi:.6g})", risk="low" if action in ("preserve", "flag") else "medium", confidence=confidence, model_id=how)
        if action == "cap":
            project[c] = N.clip(q(c), lo, hi).cast(numeric[c].dtype).alias(c)
        elif action == "flag":
            flags.append(N.outside(q(c), lo, hi).alias(free_name(f"{c}_outlier", df.columns)))
        elif action == "remove":
            mask = N.outside(q(c), lo, hi)
            remove = mask if remove is None else remove | mask
    out = df if remove is None else df.where(~remove)
    return out.select(*(project.get(c, q(c)) for c in out.columns), *flags) if project or flags else out


def impute(df: DataFrame, strategy: str = "auto", columns: list[str] | None = None, report: Report | None = None) -> DataFrame:
    """Fill every column with NULLs by mean, median, mode, or (auto) median for numbers and mode for the rest."""
    stats = describe(df, columns)
    choices = []
    for c, s in stats.items():
        if not s.missing or not s.n or not orderable(s.dtype):
            continue
        number = is_number(s.dtype)
        how = ("median" if number else "mode") if strategy == "auto" else strategy
        if how in ("mean", "median") and not number:
            if report:
                report.add("impute", c, 0, f"skipped: no {how} of a column that is not numeric")
            continue
        value = {"mean": s.mean, "median": s.median, "mode": s.mode}[how]
        choices.append(Choice(c, "impute", how, "", "", "", value=value))
        if report:
            report.add("impute", c, s.missing, f"filled with the {how} {value!r}")
    return fill(df, choices, set(), CleanOptions()) if choices else df


def handle_outliers(df: DataFrame, action: str = "flag", method: str = "iqr", factor: float | None = None, columns: list[str] | None = None, report: Report | None = None) -> DataFrame:
    """Clip or flag the outliers of every numeric column."""
    numeric = describe(df, columns or [f.name for f in df.schema if is_number(f.dataType)], modes=False)
    bounds = fences(df, numeric, method, factor)
    hits = aggregate(df, {(c, "out"): F.count_if(N.outside(q(c), lo, hi)) for c, (lo, hi, _) in bounds.items()}) if report else {}
    for (c, _), n in hits.items():
        if n:
            report.add("outliers", c, n, f"{action} ({bounds[c][2]})")
    if action == "clip":
        return df.select(*(N.clip(q(c), bounds[c][0], bounds[c][1]).cast(numeric[c].dtype if is_integer(numeric[c].dtype) else "double").alias(c) if c in bounds else q(c) for c in df.columns))
    return df.select(*(q(c) for c in df.columns), *(N.outside(q(c), lo, hi).alias(free_name(f"{c}_outlier", df.columns)) for c, (lo, hi, _) in bounds.items()))


def optimize_memory(df: DataFrame, o: CleanOptions, report: Report) -> DataFrame:
    """Integers to the narrowest type that holds them, ids as they are; text of few distinct values is marked as category."""
    stats = describe(df)
    out = []
    for f in df.schema:
        s, c = stats[f.name], q(f.name)
        if is_integer(f.dataType) and s.n and role(s, o) != "id":
            kind = next(k for k, bits in (("tinyint", 7), ("smallint", 15), ("int", 31), ("bigint", 63)) if -(2**bits) <= s.min and s.max < 2**bits)
            if T._parse_datatype_string(kind) != f.dataType:
                report.add("optimize_memory", f.name, s.rows, f"{f.dataType.simpleString()} to {kind}")
                c = c.cast(kind)
        meta = {"category": True} if is_text(f.dataType) and s.rows and (s.distinct or 0) / s.rows <= o.category_threshold else None
        out.append(c.alias(f.name, metadata=meta) if meta else c.alias(f.name))
    return df.select(*out)


# --- plans and comparisons ----------------------------------------------------------------------------------------------


def suggest_plan(df: DataFrame, options: CleanOptions | None = None, **given) -> list[Choice]:
    """What a clean would decide about missing values and outliers; writes nothing."""
    o = CleanOptions.of(options, **given)
    if o.strategy == "conservative":
        return []
    with ExitStack() as hold:
        base = hold.enter_context(held(repair(df, o, Report(), hold)))
        stats, roles, choices, _ = decide_missing(base, o)
        filled, report = fill(base, choices, set(), o), Report()
        engine_outliers(filled, roles, o, report, unfilled(stats, choices))
    more = [Choice(a.column, "outliers", a.description.split(" ")[0], roles.get(a.column, "numeric"), "", a.description, a.risk, a.confidence) for a in report.actions]
    return choices + more


def compare(df: DataFrame, strategies: tuple[str, ...] = ("conservative", "balanced", "aggressive"), **given) -> list[dict]:
    """One row for each strategy: what it changes and what is left missing."""
    out = []
    options = [CleanOptions.of(None, strategy=s, **given) for s in strategies]
    known = Report()
    with ExitStack() as hold:
        base = hold.enter_context(held(repair(df, options[0], known, hold)))  # the same for all strategies, and so are its statistics
        stats = describe(base) if any(o.strategy != "conservative" for o in options) else None
        for s, o in zip(strategies, options, strict=True):
            cleaned, report = judged(base, o, deepcopy(known), stats)
            left = aggregate(cleaned, {("", "rows"): F.count(F.lit(1)), **{(c, "gone"): F.count_if(q(c).isNull()) for c in cleaned.columns}})
            out.append({"strategy": s, "rows": left["", "rows"], "columns": len(cleaned.columns), "actions": len(report.actions), "cells_changed": sum(a.count for a in report.actions), "missing_left": sum(v for (c, _), v in left.items() if c), "warnings": len(report.warnings)})
    return out


def collinear_partners(df: DataFrame, column: str, numeric: list[str], least: float = 0.4, most: float = 0.98, k: int = 5) -> list[str]:
    """Numeric columns that go along with ``column`` but not nearly the same as one chosen before."""
    corr = correlations(df, numeric)
    r = lambda a, b: corr.get((a, b), corr.get((b, a), 0.0))
    out: list[str] = []
    for c in sorted((c for c in numeric if c != column and r(column, c) >= least), key=lambda c: (-r(column, c), c)):
        if len(out) < k and all(r(c, x) < most for x in out):
            out.append(c)
    return out
