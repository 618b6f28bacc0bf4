"""Cleaning of micro-batches with running statistics: state of bounded size, merged batch by batch.

Used with Structured Streaming through ``foreachBatch``: a batch id that was written before is skipped, so replays do no harm. What a batch
changes in the state counts only once its sink has returned, so a batch whose write failed is done again. Records and ids of past batches are kept
up to a bound, their sums for good. Duplicates across batches are found by the hashes of the last ``dedup_window`` batches, a table each in
the shared folder. The state of a column is a count, moments (merged by Chan's formula), extremes, quantiles from a merged sketch of the batches, and the most frequent
values up to a bound.
"""

from __future__ import annotations

import copy
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.operators.dedup import recent_window_dedup, row_hash
from quartzite.operators.entity import discard, stored
from quartzite.operators.quality import trust_score
from quartzite.plans.cleaning import Choice, fill, repair
from quartzite.plans.config import CleanOptions
from quartzite.plans.report import Report
from quartzite.plans.stats import aggregate, family, is_number, is_text, q

GRID = tuple(i / 20 for i in range(21))
TOP, ROLLING = 256, 20
#: Records, and ids of written batches, that are kept.
KEPT = 1000


@dataclass
class Moments:
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0

    def merge(self, n: int, mean: float, var_pop: float) -> None:
        """Chan's parallel update."""
        if not n:
            return
        total, gap = self.n + n, mean - self.mean
        self.m2 += var_pop * n + gap * gap * self.n * n / total
        self.mean += gap * n / total
        self.n = total

    @property
    def std(self) -> float:
        return (self.m2 / (self.n - 1)) ** 0.5 if self.n > 1 else 0.0


@dataclass
class ColumnState:
    family: str
    rows: int = 0
    missing: int = 0
    moments: Moments = field(default_factory=Moments)
    low: float | None = None
    high: float | None = None
    grid: list[float] = field(default_factory=list)
    grid_n: int = 0
    top: dict[str, int] = field(default_factory=dict)
    distinct_mean: float = 0.0
    batches: int = 0

    @property
    def median(self) -> float | None:
        return self.grid[len(self.grid) // 2] if self.grid else None

    @property
    def skew(self) -> float:
        """Pearson's second coefficient, from what the state has."""
        return 3 * (self.moments.mean - (self.median or 0.0)) / self.moments.std if self.moments.std else 0.0

    def merge_grid(self, quantiles: list[float], n: int) -> None:
        """Weighted merge of two quantile grids by their distribution functions."""
        if not self.grid:
            self.grid, self.grid_n = list(quantiles), n
            return
        points = sorted({*self.grid, *quantiles})
        share = [(self.grid_n * below(self.grid, x) + n * below(quantiles, x)) / (self.grid_n + n) for x in points]
        out, k = [], 0
        for p in GRID:
            while k < len(points) - 1 and share[k] < p:
                k += 1
            if k == 0 or share[k] == share[k - 1]:
                out.append(points[k])
            else:
                out.append(points[k - 1] + (points[k] - points[k - 1]) * min(1.0, max(0.0, (p - share[k - 1]) / (share[k] - share[k - 1]))))
        self.grid, self.grid_n = out, self.grid_n + n

    def merge_top(self, counts: dict[str, int]) -> None:
        """Space-Saving: a new value takes the place, and the count, of the rarest."""
        for v, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
            if v in self.top or len(self.top) < TOP:
                self.top[v] = self.top.get(v, 0) + n
            else:
                least = min(self.top, key=lambda k: (self.top[k], k))
                self.top[v] = self.top.pop(least) + n


def below(grid: list[float], x: float) -> float:
    if x < grid[0]:
        return 0.0
    if x >= grid[-1]:
        return 1.0
    k = max(i for i, g in enumerate(grid) if g <= x)
    return GRID[k] + (GRID[k + 1] - GRID[k]) * ((x - grid[k]) / (grid[k + 1] - grid[k]))


@dataclass(frozen=True)
class StreamOptions:
    warmup: int = 2
    missing_jump: float = 0.25
    distinct_factor: float = 5.0
    mean_z: float = 4.0
    least_trust: float | None = None
    dedup: bool = False
    dedup_window: int = 10


class StreamCleaner:
    """``process(batch, batch_id)`` gives the cleaned batch and a record of it; ``as_sink`` is a function for foreachBatch."""

    def __init__(self, options: CleanOptions | None = None, stream: StreamOptions = StreamOptions()) -> None:
        self.options, self.stream = options or CleanOptions(drop_duplicates=False, fix_dtypes=False), stream
        self.columns: dict[str, ColumnState] = {}
        self.records: list[dict] = []
        self.done: list[int] = []
        self.sums = {"batches": 0, "rows": 0, "trusted_rows": 0, "trust": 0.0}
        self.recent: list[str] = []
        self.pending: dict | None = None

    def seen(self, spark: SparkSession) -> DataFrame | None:
        """The hashes (h) of the last batches."""
        return spark.read.parquet(*self.recent) if self.recent else None

    def observe(self, df: DataFrame) -> tuple[int, dict]:
        wanted = {("", "rows"): F.count(F.lit(1))}
        for f in df.schema:
            c = q(f.name)
            wanted[f.name, "n"] = F.count(c)
            wanted[f.name, "distinct"] = F.approx_count_distinct(c)
            if is_number(f.dataType):
                d = c.cast("double")
                wanted |= {(f.name, "mean"): F.avg(d), (f.name, "var"): F.var_pop(d), (f.name, "low"): F.min(d), (f.name, "high"): F.max(d), (f.name, "grid"): F.percentile_approx(d, list(GRID), 10_000)}
            elif is_text(f.dataType):
                wanted[f.name, "top"] = F.expr(f"approx_top_k(`{f.name}`, {TOP // 4})")
        got = aggregate(df, wanted)
        return got["", "rows"], got

    def drift(self, df: DataFrame, got: dict, rows: int) -> list[dict]:
        out = []
        say = lambda check, c, value: out.append({"check": check, "column": c, "value": value})
        types = {f.name: family(f.dataType) for f in df.schema}
        for c in self.columns:
            if c not in types:
                say("missing_column", c, None)
        for c, kind in types.items():
            s = self.columns.get(c)
            if s is None:
                say("new_column", c, kind)
                continue
            if kind != s.family:
                say("dtype", c, kind)
                continue
            if rows and s.rows and abs((rows - got[c, "n"]) / rows - s.missing / s.rows) > self.stream.missing_jump:
                say("missing_rate", c, (rows - got[c, "n"]) / rows)
            distinct = got[c, "distinct"]
            if distinct > 20 and s.batches > 1 and s.distinct_mean and distinct > self.stream.distinct_factor * s.distinct_mean:
                say("cardinality", c, distinct)
            if (c, "mean") in got and got[c, "mean"] is not None and s.moments.std and got[c, "n"]:
                z = abs(got[c, "mean"] - s.moments.mean) / (s.moments.std / got[c, "n"] ** 0.5)
                if z > self.stream.mean_z:
                    say("distribution", c, z)
        return out

    def learn(self, columns: dict[str, ColumnState], df: DataFrame, got: dict, rows: int) -> None:
        for f in df.schema:
            s = columns.setdefault(f.name, ColumnState(family(f.dataType)))
            n = got[f.name, "n"]
            s.rows, s.missing = s.rows + rows, s.missing + rows - n
            s.distinct_mean = (s.distinct_mean * s.batches + got[f.name, "distinct"]) / (s.batches + 1)
            s.batches += 1
            if (f.name, "mean") in got and n:
                s.moments.merge(n, got[f.name, "mean"], got[f.name, "var"])
                s.low = got[f.name, "low"] if s.low is None else min(s.low, got[f.name, "low"])
                s.high = got[f.name, "high"] if s.high is None else max(s.high, got[f.name, "high"])
                s.merge_grid(list(got[f.name, "grid"]), n)
            if (f.name, "top") in got:
                s.merge_top({r[0]: r[1] for r in got[f.name, "top"] if r[0] is not None})

    def choices(self, columns: dict[str, ColumnState], df: DataFrame) -> list[Choice]:
        out = []
        for f in df.schema:
            s = columns[f.name]
            share = s.missing / s.rows if s.rows else 0.0
            if not share or share > self.options.missing_threshold_medium:
                continue
            if is_number(f.dataType) and s.moments.n:
                out.append(Choice(f.name, "missing", "running", "numeric", "", "", value=s.moments.mean if abs(s.skew) < 0.5 and share <= self.options.missing_threshold_low else s.median))
            elif is_text(f.dataType) and s.top:
                best = min(s.top, key=lambda k: (-s.top[k], k))
                n = s.rows - s.missing
                out.append(Choice(f.name, "missing", "running", "categorical", "", "", value=best if s.top[best] >= 0.5 * n else "Unknown"))
        return out

    def process(self, batch: DataFrame, batch_id: int, commit: bool = True) -> tuple[DataFrame, dict] | None:
        """The cleaned batch and its record. With ``commit`` off the state stays as it was until ``commit()``."""
        if batch_id in self.done or self.done and batch_id < self.done[0] and len(self.done) == KEPT:
            return None
        report = Report()
        df = repair(batch, self.options, report)
        hashes = None
        if self.stream.dedup:
            df, _ = stored(recent_window_dedup(df, self.seen(df.sparkSession)))
            _, hashes = stored(df.select(row_hash(df.columns).alias("h")))
        rows, got = self.observe(df)
        found = self.drift(df, got, rows) if self.columns else []
        columns = copy.deepcopy(self.columns)
        self.learn(columns, df, got, rows)
        warm = self.sums["batches"] >= self.stream.warmup
        out = fill(df, self.choices(columns, df), set(), self.options) if warm else df
        trust = trust_score(out)["score"] if self.stream.least_trust is not None else None
        record = {"batch_id": batch_id, "rows": rows, "drift": found, "imputed": warm, "trust": trust, "passed": trust is None or trust >= self.stream.least_trust}
        self.pending = {"columns": columns, "record": record, "hashes": hashes, "spark": df.sparkSession}
        if commit:
            self.commit()
        return out, record

    def commit(self) -> None:
        """What the last batch changed now counts."""
        new, self.pending = self.pending, None
        if not new:
            return
        record = new["record"]
        self.columns = new["columns"]
        self.records = [*self.records, record][-KEPT:]
        self.done = sorted([*self.done, record["batch_id"]])[-KEPT:]
        self.sums["batches"] += 1
        self.sums["rows"] += record["rows"]
        if record["trust"] is not None:
            self.sums["trusted_rows"] += record["rows"]
            self.sums["trust"] += record["rows"] * record["trust"]
        if new["hashes"]:
            self.recent.append(new["hashes"])
            while len(self.recent) > self.stream.dedup_window:
                discard(new["spark"], self.recent.pop(0))

    def as_sink(self, write):
        def sink(batch: DataFrame, batch_id: int) -> None:
            got = self.process(batch, batch_id, commit=False)
            if got:
                write(got[0], batch_id)
                self.commit()

        return sink

    def finalize(self) -> dict:
        weighted = self.sums["trust"] / self.sums["trusted_rows"] if self.sums["trusted_rows"] else None
        last = [r["trust"] for r in self.records if r["trust"] is not None][-ROLLING:]
        return {"batches": self.sums["batches"], "rows": self.sums["rows"], "trust": weighted, "rolling_trust": sum(last) / len(last) if last else None, "drift": [d | {"batch_id": r["batch_id"]} for r in self.records for d in r["drift"]]}

    def state_json(self) -> str:
        return json.dumps({"columns": {c: asdict(s) for c, s in self.columns.items()}, "done": self.done, "records": self.records, "sums": self.sums, "recent": self.recent}, sort_keys=True)

    @classmethod
    def from_json(cls, text: str, options: CleanOptions | None = None, stream: StreamOptions = StreamOptions()) -> StreamCleaner:
        out, state = cls(options, stream), json.loads(text)
        out.done, out.records, out.sums, out.recent = state["done"], state["records"], state["sums"], state["recent"]
        for c, s in state["columns"].items():
            out.columns[c] = ColumnState(**(s | {"moments": Moments(**s["moments"])}))
        return out
