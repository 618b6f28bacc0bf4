"""The decision log of a clean: actions, warnings, and their tables."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

AUDIT_SCHEMA = "step string, column string, count long, description string, rationale string, risk string, confidence double, model_id string"
FINDING_SCHEMA = "finding_id string, check string, column string, severity string, count long, message string"
#: Spellings of severities and what they stand for.
SEVERITIES = {"info": "info", "low": "info", "notice": "info", "warning": "warning", "warn": "warning", "medium": "warning", "error": "error", "high": "error", "critical": "error", "fail": "error"}


@dataclass(frozen=True)
class Action:
    step: str
    column: str | None
    count: int
    description: str
    rationale: str = ""
    risk: str = "low"
    confidence: float = 1.0
    model_id: str | None = None


@dataclass
class Report:
    rows_before: int = 0
    rows_after: int = 0
    columns_before: int = 0
    columns_after: int = 0
    actions: list[Action] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    recommendations: list[str] = field(default_factory=list)

    def add(self, step: str, column: str | None, count: int, description: str, **more) -> None:
        self.actions.append(Action(step, column, int(count), description, **more))

    def counts(self) -> list[tuple[str, str | None, int]]:
        return [(a.step, a.column, a.count) for a in self.actions]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(a).values()) for a in self.actions], AUDIT_SCHEMA)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)

    def summary(self) -> str:
        head = f"{self.rows_before} -> {self.rows_after} rows, {self.columns_before} -> {self.columns_after} columns, {len(self.actions)} actions"
        return "\n".join([head, *(f"- {a.step} {a.column or ''}: {a.description}" for a in self.actions), *(f"! {w}" for w in self.warnings)])

    def findings(self) -> list[dict]:
        """Risky actions and warnings as normalised findings."""
        rows = [finding(a.step, a.column, "warning" if a.risk != "low" else "info", a.count, a.description) for a in self.actions if a.risk != "low"]
        return rows + [finding("warning", None, "warning", 0, w) for w in self.warnings]


def severity(name: str) -> str:
    try:
        return SEVERITIES[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown severity {name!r}") from None


def finding(check: str, column: str | None, level: str, count: int, message: str) -> dict:
    level = severity(level)
    ident = hashlib.sha1("|".join(map(str, (check, column, level, message))).encode()).hexdigest()[:12]
    return {"finding_id": ident, "check": check, "column": column, "severity": level, "count": int(count), "message": message}
