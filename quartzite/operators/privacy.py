"""Detection of personal data in text columns, scrubbing of its spans, and privacy policies.

Span detection is procedural (greedy, without overlaps), so it runs in Arrow batches over the texts that a built-in prefilter lets pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quartzite.operators.values import MaskRule, mask, text_columns
from quartzite.plans.stats import q

# Entity -> (pattern, base score), in the order of declaration.
PATTERNS = {
    "EMAIL": (r"[\w.+-]+@[\w-]+\.[\w.-]+", 0.90),
    "CREDIT_CARD": (r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b", 0.80),
    "SSN": (r"\b\d{3}-\d{2}-\d{4}\b", 0.85),
    "IBAN": (r"\b[A-Z]{2}\d{2}[A-Z0-9]{10,30}\b", 0.80),
    "IP_ADDRESS": (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", 0.70),
    "PHONE": (r"\+?\d[\d ()\-.]{7,}\d", 0.55),
    "DATE_OF_BIRTH": (r"\b\d{4}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b", 0.45),
    "ZIP_CODE": (r"\b\d{5}(?:-\d{4})?\b", 0.35),
    "ICD_CODE": (r"\b[A-TV-Z]\d{2}(?:\.\d{1,4})?\b", 0.50),
    "MRN": (r"\bMRN[:#]?\s*\d{4,10}\b", 0.70),
    "PATIENT_ID": (r"\b(?:PT|PID|PAT)[:#-]?\s*\d{4,10}\b", 0.65),
    "INSURANCE_ID": (r"\b[A-Z]{3}\d{6,12}\b", 0.50),
    "PASSPORT": (r"\b[A-Z]{1,2}\d{6,9}\b", 0.50),
    "DRIVER_LICENSE": (r"\b[A-Z]\d{6,12}\b", 0.45),
    "GEO_LOCATION": (r"[-+]?\d{1,3}\.\d{3,},\s*[-+]?\d{1,3}\.\d{3,}", 0.45),
}
# Words near a span that make it likelier.
HEALTH_WORDS = ("patient", "mrn", "dob", "diagnosis", "medication", "lab", "encounter", "provider")
PERSON_WORDS = ("name", "email", "phone", "address", "passport", "national id", "location")
#: Looked for unless asked otherwise: all but coordinates.
DEFAULT_ENTITIES = tuple(k for k in PATTERNS if k != "GEO_LOCATION")
SPAN = "entity_type string, start int, end int, score double, source string"
# Every pattern needs a digit or an @.
PREFILTER = "[0-9@]"


@dataclass(frozen=True)
class Detection:
    entities: tuple[str, ...] = DEFAULT_ENTITIES
    custom: tuple[tuple[str, str, float], ...] = ()
    use_context: bool = True
    window: int = 40
    min_score: float = 0.5

    def patterns(self) -> list[tuple[str, re.Pattern, float]]:
        chosen = [(k, re.compile(p), s) for k, (p, s) in PATTERNS.items() if k in self.entities] + [(k, re.compile(p), s) for k, p, s in self.custom]
        return sorted(chosen, key=lambda x: -x[2])


def luhn(text: str) -> bool:
    digits = [int(c) for c in text if c in "0123456789"]
    doubled = [d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
    return len(digits) >= 13 and sum(doubled) % 10 == 0


def spans(text: str | None, column: str, d: Detection, compiled: list | None = None) -> list[tuple[str, int, int, float, str]]:
    """(entity, start, end, score, source) of a text; stronger patterns take their spans first."""
    if not text:
        return []
    taken: list[tuple[int, int]] = []
    out = []
    name = column.lower().replace("_", " ")
    for kind, pattern, base in compiled or d.patterns():
        for m in pattern.finditer(text):
            a, b = m.span()
            if any(x < b and a < y for x, y in taken):
                continue
            score, source = base, "regex"
            if kind == "CREDIT_CARD" and luhn(m.group()):
                score, source = max(score, 0.95), "checksum"
            if d.use_context:
                near = text[max(0, a - d.window) : b + d.window].lower() + " " + name
                boost = 0.15 * any(w in near for w in HEALTH_WORDS) + 0.10 * any(w in near for w in PERSON_WORDS)
                if boost:
                    score, source = min(1.0, score + boost), "context" if source == "regex" else source
            if score >= d.min_score:
                taken.append((a, b))
                out.append((kind, a, b, score, source))
    return sorted(out, key=lambda s: s[1])


def detect(df: DataFrame, id_column: str, columns: list[str] | None = None, d: Detection = Detection()) -> DataFrame:
    """id, column, entity_type, start, end, score, source: a row for each span in the text columns."""
    out = None
    for c in columns or [x for x in text_columns(df) if x != id_column]:

        def run(batches: Iterator[pa.RecordBatch], c: str = c) -> Iterator[pa.RecordBatch]:
            compiled = d.patterns()
            for batch in batches:
                rows = [(i, *s) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for s in spans(t.as_py(), c, d, compiled)]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)], ["id", "entity_type", "start", "end", "score", "source"])

        texts = df.where(q(c).rlike(PREFILTER) if not d.custom else q(c).isNotNull()).select(q(id_column).cast("string").alias("id"), q(c).alias("t"))
        found = texts.mapInArrow(run, f"id string, {SPAN}").withColumn("column", F.lit(c))
        out = found if out is None else out.unionByName(found)
    return out


def scrub(df: DataFrame, columns: list[str], d: Detection = Detection()) -> DataFrame:
    """Every span in the columns replaced by <ENTITY>."""

    def scrubber(c: str):
        @F.pandas_udf("string")
        def run(texts):
            compiled = d.patterns()

            def one(t):
                if t is None:
                    return None
                for kind, a, b, *_ in reversed(spans(t, c, d, compiled)):
                    t = f"{t[:a]}<{kind}>{t[b:]}"
                return t

            return texts.map(one)

        return run

    new = {c: F.when(q(c).rlike(PREFILTER), scrubber(c)(q(c))).otherwise(q(c)) for c in columns}
    return df.select(*(new[c].alias(c) if c in new else q(c) for c in df.columns))


def anonymize(df: DataFrame, rules: list[MaskRule] = (), d: Detection | None = None) -> DataFrame:
    """Column rules first, then the detected spans of the text columns that no rule names."""
    out = mask(df, list(rules)) if rules else df
    named = {c for r in rules for c in r.chosen(df.columns)}
    rest = [c for c in text_columns(out) if c not in named]
    return scrub(out, rest, d) if d and rest else out


# --- policies ----------------------------------------------------------------------------------------------------------------

ACTIONS = ("preserve", "redact", "tokenize", "pseudonymize", "drop", "minimize", "quarantine")


@dataclass(frozen=True)
class PolicyRule:
    """Columns by name, by pattern on names, or by the entity found in their values; and what to do with them."""

    rule_id: str
    action: str
    columns: tuple[str, ...] = ()
    pattern: str | None = None
    entity: str | None = None
    jurisdictions: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.action not in ACTIONS:
            raise ValueError(f"{self.rule_id}: unknown action {self.action!r}")


@dataclass(frozen=True)
class Policy:
    name: str
    rules: tuple[PolicyRule, ...]
    jurisdiction: str | None = None
    key: str = ""
    parents: dict[str, str] = field(default_factory=lambda: {"UK": "EU"})

    def in_scope(self) -> list[PolicyRule]:
        here = {self.jurisdiction, self.parents.get(self.jurisdiction)}
        return [r for r in self.rules if not r.jurisdictions or not self.jurisdiction or here & set(r.jurisdictions)]


def classify(df: DataFrame, policy: Policy, sample: int = 200, d: Detection = Detection()) -> dict[str, PolicyRule]:
    """Column to the rule that fits it best: by name, then by entity in the first ``sample`` rows, then by pattern."""
    out: dict[str, PolicyRule] = {}
    rules = policy.in_scope()
    head = df.select(*(q(c) for c in text_columns(df))).limit(sample).collect() if any(r.entity for r in rules) else []
    for c in df.columns:
        named = [r for r in rules if c in r.columns]
        kinds = {s[0] for r in head if c in r.asDict() for s in spans(r[c], c, d)}
        found = [r for r in rules if r.entity and r.entity in kinds]
        alike = [r for r in rules if r.pattern and re.search(r.pattern, c, re.I)]
        if best := (named or found or alike):
            out[c] = best[0]
    return out


def apply_policy(df: DataFrame, policy: Policy, **options) -> tuple[DataFrame, dict]:
    """The protected frame in one projection, and what was done; the score falls by ten for each column left quarantined or unprotected."""
    chosen = classify(df, policy, **options)
    strategy = {"redact": "redact", "tokenize": "tokenize", "pseudonymize": "surrogate", "drop": "drop", "minimize": "drop"}
    if any(r.action in ("tokenize", "pseudonymize") for r in chosen.values()) and not policy.key:
        raise ValueError("the policy tokenises but has no key")
    rules = [MaskRule(strategy[r.action], (c,), salt=policy.key, keep_last=0) for c, r in chosen.items() if r.action in strategy]
    out = mask(df, rules) if rules else df
    held = [c for c, r in chosen.items() if r.action == "quarantine"]
    safe = len([c for c, r in chosen.items() if r.action in strategy])
    score = max(0.0, (100.0 * safe / len(chosen) if chosen else 100.0) - 10 * len(held))
    return out, {"policy": policy.name, "columns": {c: (r.rule_id, r.action) for c, r in chosen.items()}, "quarantined": held, "score": score}


# Packs of the common regimes.
PACKS = {
    "hipaa": Policy("hipaa", (PolicyRule("H1", "redact", pattern=r"ssn|social"), PolicyRule("H2", "tokenize", pattern=r"mrn|patient"), PolicyRule("H3", "redact", pattern=r"name|phone|email|fax"), PolicyRule("H4", "minimize", pattern=r"address|zip|street")), key="change-me"),
    "gdpr": Policy("gdpr", (PolicyRule("G1", "pseudonymize", pattern=r"name|email|phone", jurisdictions=("EU",)), PolicyRule("G2", "redact", pattern=r"passport|national", jurisdictions=("EU",)), PolicyRule("G3", "minimize", pattern=r"address|location", jurisdictions=("EU",))), key="change-me"),
    "pci": Policy("pci", (PolicyRule("P1", "tokenize", entity="CREDIT_CARD"), PolicyRule("P2", "drop", pattern=r"cvv|cvc|pin"))  , key="change-me"),
    "ferpa": Policy("ferpa", (PolicyRule("F1", "tokenize", pattern=r"student"), PolicyRule("F2", "redact", pattern=r"name|birth|parent"), PolicyRule("F3", "quarantine", pattern=r"discipline|grade")), key="change-me"),
}
