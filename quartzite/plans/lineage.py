"""Lineage of steps over schemas, and its OpenLineage events; compliance reports from a clean's log."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.plans.report import Report
from quartzite.plans.stats import q


def schema_of(df: DataFrame) -> list[dict]:
    return [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]


def fingerprint(df: DataFrame) -> str:
    """Of the rows without regard to their order: sums of two independent row hashes, and the count."""
    columns = [q(c) for c in df.columns]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64(F.lit(7), *columns).cast("decimal(38,0)")).alias("b")).first()
    import hashlib

    return hashlib.sha256(f"{r.n}|{r.a}|{r.b}|{schema_of(df)}".encode()).hexdigest()


@dataclass
class Lineage:
    job: str
    namespace: str = "quartzite"
    run_id: str = field(default_factory=lambda: str(uuid.uuid4()))
    steps: list[dict] = field(default_factory=list)

    def record(self, step: str, before: DataFrame, after: DataFrame, columns: dict[str, list[str]] | None = None) -> None:
        """``columns`` maps an output column to the inputs that it comes from; those of the same name by default."""
        names = set(before.columns)
        self.steps.append({"step": step, "at": datetime.now(timezone.utc).isoformat(), "input": schema_of(before), "output": schema_of(after), "columns": columns or {c: [c] for c in after.columns if c in names}})

    def openlineage(self) -> list[dict]:
        out = []
        for s in self.steps:
            base = {"run": {"runId": self.run_id}, "job": {"namespace": self.namespace, "name": f"{self.job}.{s['step']}"}, "eventTime": s["at"]}
            out.append(base | {"eventType": "START", "inputs": [{"namespace": self.namespace, "name": self.job, "facets": {"schema": {"fields": s["input"]}}}], "outputs": []})
            lineage = {c: {"inputFields": [{"namespace": self.namespace, "name": self.job, "field": i} for i in ins]} for c, ins in s["columns"].items()}
            out.append(base | {"eventType": "COMPLETE", "inputs": [], "outputs": [{"namespace": self.namespace, "name": self.job, "facets": {"schema": {"fields": s["output"]}, "columnLineage": {"fields": lineage}}}]})
        return out


# Identifiers of the safe-harbour list, by hints in column names.
HIPAA_IDENTIFIERS = {
    "names": ("name", "surname"), "geographic": ("address", "zip", "city", "street"), "dates": ("birth", "dob", "date"), "phone": ("phone", "mobile"), "fax": ("fax",), "email": ("email", "mail"),
    "ssn": ("ssn", "social"), "medical_record": ("mrn", "record"), "health_plan": ("plan", "insurance"), "account": ("account",), "certificate": ("license", "certificate"), "vehicle": ("vehicle", "plate", "vin"),
    "device": ("device", "serial"), "url": ("url",), "ip": ("ip_", "ip_address"), "biometric": ("finger", "biometric", "voice"), "photo": ("photo", "image"), "other": ("unique", "identifier"),
}


def compliance(framework: str, report: Report, columns: list[str], trust: float | None = None, masked: list[str] = (), user: str = "unknown") -> list[dict]:
    """Rows (framework, section, status, detail) for 21cfr11, gdpr, alcoa, sox404 or hipaa."""
    rows: list[tuple[str, str, str]] = []
    risky = [a for a in report.actions if a.risk == "high"]
    if framework == "21cfr11":
        rows = [(f"11.10(e) {a.step}", "recorded", f"{user}: {a.column or '*'} {a.description} ({a.count})") for a in report.actions] or [("11.10(e)", "empty", "no action")]
    elif framework == "gdpr":
        rows = [("art30", "recorded", f"{len(columns)} columns processed by {user}"), *(("art17", "erased", c) for c in masked)]
    elif framework == "alcoa":
        tests = {"attributable": user != "unknown", "legible": True, "contemporaneous": True, "original": report.rows_before > 0, "accurate": not risky, "complete": report.rows_after >= 0, "consistent": not report.warnings, "enduring": True, "available": True}
        rows = [(k, "met" if v else "open", "") for k, v in tests.items()]
    elif framework == "sox404":
        rows = [("trust_gate", "unknown" if trust is None else "pass" if trust >= 80 else "fail", str(trust)), *(("exception", "open", f"{a.column}: {a.description}") for a in risky)]
    elif framework == "hipaa":
        for kind, hints in HIPAA_IDENTIFIERS.items():
            hit = [c for c in columns if any(h in c.lower() for h in hints)]
            rows.append((kind, "absent" if not hit else "protected" if set(hit) <= set(masked) else "exposed", ", ".join(hit)))
    else:
        raise ValueError(f"unknown framework {framework!r}")
    return [{"framework": framework, "section": s, "status": t, "detail": d} for s, t, d in rows]


def dbt_tests(model: str, contract: dict) -> dict:
    """A schema.yml of generic tests for a contract, as a dictionary."""
    columns = []
    for c, k in contract.items():
        tests: list[object] = [*(["not_null"] if not k.nullable else []), *(["unique"] if k.unique else [])]
        if k.allowed is not None:
            tests.append({"accepted_values": {"values": list(k.allowed)}})
        columns.append({"name": c, "tests": tests})
    return {"version": 2, "models": [{"name": model, "columns": columns}]}


def expectation_suite(name: str, contract: dict) -> dict:
    """An expectation suite for a contract, as a dictionary."""
    out = []
    add = lambda kind, c, **more: out.append({"expectation_type": kind, "kwargs": {"column": c, **more}})
    for c, k in contract.items():
        if not k.nullable:
            add("expect_column_values_to_not_be_null", c)
        if k.unique:
            add("expect_column_values_to_be_unique", c)
        if k.allowed is not None:
            add("expect_column_values_to_be_in_set", c, value_set=list(k.allowed))
        if k.minimum is not None or k.maximum is not None:
            add("expect_column_values_to_be_between", c, min_value=k.minimum, max_value=k.maximum)
        if k.regex:
            add("expect_column_values_to_match_regex", c, regex=f"^(?:{k.regex})$")
    return {"expectation_suite_name": name, "expectations": out}


def exception_table(df: DataFrame, id_column: str, violations: dict, redact: bool = True) -> DataFrame:
    """A row for each violated rule of a row: id, rule and the row's values, redacted by default."""
    hits = F.array_compact(F.array(*(F.when(v, F.lit(r)) for r, v in violations.items())))
    value = F.lit("<redacted>") if redact else F.to_json(F.struct(*(q(c) for c in df.columns)))
    return df.select(q(id_column).cast("string").alias("id"), F.explode(hits).alias("rule"), value.alias("row"))
