"""Profiles, trust scores, baselines, drift and contracts."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.functions import numbers as N
from quartzite.functions import text as X
from quartzite.operators.dedup import duplicate_rows
from quartzite.plans.config import CleanOptions
from quartzite.plans.inference import REPEATED, suggest
from quartzite.plans.roles import role, sensitive
from quartzite.plans.stats import aggregate, describe, family, is_number, is_text, is_time, orderable, q, without_nan

QUANTILES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
TOP, EPS = 50, 1e-6
#: Numeric columns whose distributions are compared in one job.
TOGETHER = 8


# --- profiles --------------------------------------------------------------------------------------------------------------


def profile(df: DataFrame, options: CleanOptions | None = None) -> DataFrame:
    """A row for each column: dtype, rows, missing, distinct, role, suggested type, issues."""
    o = options or CleanOptions()
    df = without_nan(df)
    stats = describe(df, at=())
    few = [c for c, s in stats.items() if is_text(s.dtype) and s.distinct <= REPEATED * s.n]
    conversions = {x.column: x for x in suggest(df, o, few, X.repaired)}
    rows = []
    for c, s in stats.items():
        to = conversions.get(c)
        issues = [x for x, there in (("missing values", s.missing), ("constant", s.rows > 1 and s.distinct is not None and s.distinct <= 1 and not s.missing), (f"looks like {to.target}" if to else "", to)) if there]
        rows.append((c, s.dtype.simpleString(), s.rows, s.missing, round(s.ratio, 6), s.distinct, role(s, o), sensitive(c), to.target if to else None, s.skew, "; ".join(issues)))
    return df.sparkSession.createDataFrame(rows, "column string, dtype string, rows long, missing long, missing_ratio double, distinct long, role string, sensitive boolean, suggested string, skew double, issues string")


# --- trust -------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TrustWeights:
    completeness: float = 0.3
    validity: float = 0.3
    uniqueness: float = 0.2
    consistency: float = 0.2

    def shares(self) -> tuple[float, float, float, float]:
        w = (self.completeness, self.validity, self.uniqueness, self.consistency)
        if min(w) < 0 or not sum(w):
            raise ValueError("weights must not be negative, nor all zero")
        return tuple(x / sum(w) for x in w)


def trust_score(df: DataFrame, weights: TrustWeights = TrustWeights()) -> dict:
    """0 to 100 from completeness, validity, uniqueness, consistency; an empty frame is 100."""
    df = without_nan(df)
    stats = describe(df, modes=False)
    rows = next((s.rows for s in stats.values()), 0)
    if not rows:
        return {"score": 100.0, "grade": "A", "completeness": 1.0, "validity": 1.0, "uniqueness": 1.0, "consistency": 1.0}
    wanted = {}
    for c, s in stats.items():
        if is_text(s.dtype):
            wanted[c, "bad"] = F.count_if((X.strip(q(c)) != q(c)) | X.is_sentinel(X.strip(q(c))))
        elif is_number(s.dtype) and s.n >= 20 and (f := N.iqr_fences(s.q1, s.q3)):
            wanted[c, "bad"] = F.count_if(N.outside(q(c), *f))
        if orderable(s.dtype):
            wanted[c, "same"] = F.min(q(c)) == F.max(q(c))
    got = aggregate(df, wanted)
    cells = rows * len(stats)
    filled = sum(s.n for s in stats.values())
    bad = sum(min(got.get((c, "bad"), 0), s.n) for c, s in stats.items())
    odd = sum(rows > 1 and (not s.n or bool(got.get((c, "same")))) for c, s in stats.items())
    parts = (filled / cells, 1 - bad / filled if filled else 0.0, 1 - duplicate_rows(df) / rows, 1 - odd / len(stats))
    score = round(100 * sum(w * p for w, p in zip(weights.shares(), parts, strict=True)), 2)
    return {"score": score, "grade": grade(score), **dict(zip(("completeness", "validity", "uniqueness", "consistency"), parts, strict=True))}


def grade(score: float) -> str:
    return "A" if score >= 90 else "B" if score >= 80 else "C" if score >= 70 else "D" if score >= 60 else "F"


def trust_gate(df: DataFrame, threshold: float = 80.0, on_fail: str = "warn") -> dict:
    if on_fail not in ("warn", "fail", "skip"):
        raise ValueError("on_fail must be warn, fail or skip")
    got = trust_score(df)
    passed = got["score"] >= threshold
    return got | {"threshold": threshold, "passed": passed, "status": "pass" if passed else on_fail}


# --- baselines and drift -------------------------------------------------------------------------------------------------


def hashed_label(label: object) -> str:
    return "h:" + hashlib.sha1(str(label).encode()).hexdigest()[:16]


def baseline(df: DataFrame, name: str = "baseline", hash_labels: bool = True) -> dict:
    """Statistics of every column, in a form that is saved as JSON."""
    df = without_nan(df)
    stats = describe(df, at=QUANTILES)
    out = {"name": name, "version": 1, "rows": next((s.rows for s in stats.values()), 0), "columns": {}}
    numeric = [c for c, s in stats.items() if is_number(s.dtype)]
    for c, s in stats.items():
        entry = {"kind": "numeric" if c in numeric else "datetime" if is_time(s.dtype) else "categorical", "family": family(s.dtype), "missing_ratio": s.ratio, "distinct": s.distinct, "unique": bool(s.n) and s.distinct == s.n}
        if c in numeric:
            entry |= {"mean": s.mean, "std": s.std_pop, "min": float(s.min) if s.n else None, "max": float(s.max) if s.n else None, "quantiles": [s.quantiles[p] for p in QUANTILES] if s.n else []}
        elif is_time(s.dtype):
            entry |= {"min": str(s.min), "max": str(s.max)}
        else:
            top = df.where(q(c).isNotNull()).groupBy(q(c).cast("string").alias("v")).count().orderBy(F.desc("count"), "v").limit(TOP).collect()
            entry["top"] = {(hashed_label(r.v) if hash_labels else r.v): r["count"] for r in top}
            entry["n"] = s.n
            entry["hashed"] = hash_labels
        out["columns"][c] = entry
    return out


def save_baseline(b: dict, path: str) -> None:
    with open(path, "w") as f:
        json.dump(b, f, sort_keys=True, indent=1)


def load_baseline(path: str) -> dict:
    with open(path) as f:
        out = json.load(f)
    if out.get("version") != 1:
        raise ValueError("unknown version of a baseline")
    return out


def grid(entry: dict) -> list[tuple[float, float]]:
    """(value, cumulative share) of a baseline's numeric column."""
    points = [(entry["min"], 0.0), *zip(entry["quantiles"], QUANTILES, strict=True), (entry["max"], 1.0)]
    out: list[tuple[float, float]] = []
    for v, p in points:
        if out and out[-1][0] == v:
            out[-1] = (v, p)
        else:
            out.append((v, p))
    return out


def ks_counts(column: str, entry: dict) -> dict[tuple[str, str], Column]:
    c = q(column)
    return {(column, "n"): F.count(c), **{(column, f"le{i}"): F.count_if(c <= v) for i, (v, _) in enumerate(grid(entry))}}


def ks_of(got: dict[tuple[str, str], int], column: str, entry: dict) -> float:
    n = got[column, "n"]
    return max((abs(got[column, f"le{i}"] / n - p) for i, (_, p) in enumerate(grid(entry))), default=0.0) if n else 0.0


def ks_statistic(df: DataFrame, column: str, entry: dict) -> float:
    """Largest gap between the baseline's piecewise distribution and the current one, on the baseline's grid; one job."""
    return ks_of(aggregate(df, ks_counts(column, entry)), column, entry)


def psi(expected: list[float], actual: list[float]) -> float:
    return sum((max(a, EPS) - max(e, EPS)) * math.log(max(a, EPS) / max(e, EPS)) for e, a in zip(expected, actual, strict=True))


def psi_bins(entry: dict) -> tuple[list[float], list[float]]:
    """Edges between the baseline's quantiles, equal ones merged, and the baseline's share of each bin."""
    edges, shares, last = [], [], 0.0
    for v, p in grid(entry)[1:-1]:
        edges.append(v)
        shares.append(p - last)
        last = p
    return edges, [*shares, 1 - last]


def psi_counts(column: str, entry: dict) -> dict[tuple[str, str], Column]:
    c, edges = q(column), psi_bins(entry)[0]
    return {(column, "n"): F.count(c), **{(column, f"b{i}"): F.count_if((c <= edges[i] if i < len(edges) else F.lit(True)) & (c > edges[i - 1] if i else F.lit(True))) for i in range(len(edges) + 1)}}


def psi_of(got: dict[tuple[str, str], int], column: str, entry: dict) -> float:
    n, shares = got[column, "n"], psi_bins(entry)[1]
    return psi(shares, [got[column, f"b{i}"] / n for i in range(len(shares))]) if n else 0.0


def psi_numeric(df: DataFrame, column: str, entry: dict) -> float:
    """Population stability over the bins between the baseline's quantiles; one job."""
    return psi_of(aggregate(df, psi_counts(column, entry)), column, entry)


def psi_categorical(df: DataFrame, column: str, entry: dict) -> float:
    """Over the baseline's most frequent values and one bucket for the rest."""
    label = F.col("v")
    if entry["hashed"]:
        label = F.concat(F.lit("h:"), F.substring(F.sha1(label), 1, 16))
    keys = list(entry["top"])
    values = df.where(q(column).isNotNull()).groupBy(q(column).cast("string").alias("v")).count()  # labels are made once for each value
    counts = {r.k: r["count"] for r in values.groupBy(F.when(label.isin(keys), label).alias("k")).agg(F.sum("count").alias("count")).collect()}  # at most TOP + 1 rows
    n, base = sum(counts.values()), entry["n"]
    if not n or not base:
        return 0.0
    known = sum(entry["top"].values())
    return psi([entry["top"][k] / base for k in keys] + [1 - known / base], [counts.get(k, 0) / n for k in keys] + [counts.get(None, 0) / n])


def drift(df: DataFrame, base: dict) -> list[dict]:
    """Findings (check, column, severity, value) of schema, statistics and distributions against a baseline."""
    df = without_nan(df)
    known = base["columns"]
    stats = describe(df, modes=[c for c, e in known.items() if e["unique"]], at=())
    out: list[dict] = []
    say = lambda check, c, level, value: out.append({"check": check, "column": c, "severity": level, "value": value})
    for c in known:
        if c not in stats:
            say("column_removed", c, "error", None)
    for c in stats:
        if c not in known:
            say("column_added", c, "warning", None)
    if [c for c in known if c in stats] != [c for c in df.columns if c in known]:
        say("column_order", None, "info", None)
    rows = next((s.rows for s in stats.values()), 0)
    if base["rows"] and abs(rows - base["rows"]) / base["rows"] > 0.5:
        say("row_count", None, "warning", rows)
    same = [c for c, e in known.items() if c in stats and e["kind"] == "numeric" and e["quantiles"] and family(stats[c].dtype) == e["family"] and stats[c].n and rows >= 30]
    got: dict[tuple[str, str], int] = {}
    for i in range(0, len(same), TOGETHER):
        got |= aggregate(df, {k: v for c in same[i : i + TOGETHER] for k, v in (ks_counts(c, known[c]) | psi_counts(c, known[c])).items()})
    for c, e in known.items():
        if c not in stats:
            continue
        s = stats[c]
        if family(s.dtype) != e["family"]:
            say("dtype", c, "error", family(s.dtype))
            continue
        if s.ratio - e["missing_ratio"] > 0.10:
            say("missing_ratio", c, "error" if s.ratio - e["missing_ratio"] > 0.25 else "warning", round(s.ratio, 6))
        if e["unique"] and s.n and s.distinct < s.n:
            say("uniqueness", c, "error", s.distinct)
        if rows < 30 or not s.n:
            continue
        if e["kind"] == "numeric" and e["quantiles"]:
            for check, value in (("ks", ks_of(got, c, e)), ("psi", psi_of(got, c, e))):
                if value >= 0.10:
                    say(check, c, "error" if value >= 0.25 else "warning", round(value, 6))
        elif e["kind"] == "categorical":
            value = psi_categorical(df, c, e)
            if value >= 0.10:
                say("psi", c, "error" if value >= 0.25 else "warning", round(value, 6))
        elif e["kind"] == "datetime" and (str(s.min) < e["min"] or str(s.max) > e["max"]):
            say("range", c, "warning", f"{s.min} to {s.max}")
    return out


@dataclass(frozen=True)
class ColumnContract:
    dtype: str | None = None
    nullable: bool = True
    unique: bool = False
    max_missing: float | None = None
    max_distinct: int | None = None
    allowed: tuple | None = None
    minimum: float | None = None
    maximum: float | None = None
    regex: str | None = None
    required: bool = True


def check_contract(df: DataFrame, contract: dict[str, ColumnContract], allow_extra: bool = True) -> list[dict]:
    """Violations (check, column, count) of a contract; every value check of every column in one job."""
    out, wanted = [], {("", "rows"): F.count(F.lit(1))}
    types = {f.name: family(f.dataType) for f in df.schema}
    for c, k in contract.items():
        if c not in types:
            if k.required:
                out.append({"check": "required", "column": c, "count": 1})
            continue
        v = q(c)
        if k.dtype and types[c] != k.dtype:
            out.append({"check": "dtype", "column": c, "count": 1})
        wanted[c, "missing"] = F.count_if(v.isNull())
        if k.unique or k.max_distinct is not None:
            wanted[c, "distinct"] = F.count_distinct(v)
        if k.allowed is not None:
            wanted[c, "allowed"] = F.count_if(~v.isin(list(k.allowed)))
        if k.minimum is not None:
            wanted[c, "minimum"] = F.count_if(v < k.minimum)
        if k.maximum is not None:
            wanted[c, "maximum"] = F.count_if(v > k.maximum)
        if k.regex:
            wanted[c, "regex"] = F.count_if(~v.cast("string").rlike(f"^(?:{k.regex})\\z"))
    got = aggregate(df, wanted)
    rows = got["", "rows"]
    for c, k in contract.items():
        if (c, "missing") not in got:
            continue
        gone = got[c, "missing"]
        say = lambda check, n, c=c: n and out.append({"check": check, "column": c, "count": int(n)})
        say("nullable", gone if not k.nullable else 0)
        say("max_missing", gone if k.max_missing is not None and rows and gone / rows > k.max_missing else 0)
        say("unique", rows - gone - got[c, "distinct"] if k.unique else 0)
        say("max_distinct", got[c, "distinct"] if k.max_distinct is not None and got[c, "distinct"] > k.max_distinct else 0)
        for check in ("allowed", "minimum", "maximum", "regex"):
            say(check, got.get((c, check), 0))
    if not allow_extra:
        out += [{"check": "extra", "column": c, "count": 1} for c in df.columns if c not in contract]
    return out
