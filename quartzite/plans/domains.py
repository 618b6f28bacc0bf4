"""Domain packs: rules in five layers over canonical fields, one fused count for all, a trust score and repairs."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quartzite.functions import checks as K
from quartzite.plans.stats import aggregate, q

LAYERS = ("schema", "format", "reference", "business", "semantic")
WEIGHTS = {"error": 1.0, "warning": 0.25, "info": 0.05}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    layer: str
    severity: str
    fields: tuple[str, ...]
    check: str
    params: dict = field(default_factory=dict)
    repair: str = "flag_only"

    def __post_init__(self) -> None:
        if self.layer not in LAYERS or self.severity not in WEIGHTS:
            raise ValueError(f"{self.rule_id}: bad layer or severity")
        if self.repair.split(":")[0] not in ("none", "flag_only", "reject", "fill_default", "coerce"):
            raise ValueError(f"{self.rule_id}: bad repair {self.repair!r}")


#: name -> (columns by field, parameters, as_of) -> violation
CHECKS: dict[str, Callable[..., Column]] = {
    "not_null": lambda cs, p, t: K.not_null(*cs),
    "regex": lambda cs, p, t: K.regex(p["pattern"], *cs),
    "enum": lambda cs, p, t: K.enum(p["values"], p.get("case_insensitive", False), *cs),
    "range": lambda cs, p, t: K.in_range(p.get("min"), p.get("max"), *cs),
    "unique": lambda cs, p, t: K.unique(*cs),
    "iso_date": lambda cs, p, t: K.iso_date(*cs),
    "iso_datetime": lambda cs, p, t: K.iso_datetime(*cs),
    "fhir_date": lambda cs, p, t: K.fhir_date(*cs),
    "partial_date": lambda cs, p, t: K.partial_date(*cs),
    "not_future": lambda cs, p, t: K.not_future(t, *cs),
    "numeric": lambda cs, p, t: K.numeric(*cs),
    "nonneg": lambda cs, p, t: K.nonneg(*cs),
    "nonneg_number": lambda cs, p, t: K.nonneg_number(*cs),
    "positive": lambda cs, p, t: K.positive(*cs),
    "positive_integer": lambda cs, p, t: K.positive_integer(*cs),
    "two_decimals": lambda cs, p, t: K.two_decimals(*cs),
    "both_present": lambda cs, p, t: K.both_present(*cs),
    "at_least_one": lambda cs, p, t: K.at_least_one(*cs),
    "date_order": lambda cs, p, t: K.date_order(*cs),
    "balanced": lambda cs, p, t: K.balanced(*cs, p.get("tolerance", 0.01)),
    "not_both_sided": lambda cs, p, t: K.sure((K.number(cs[0]) != 0) & (K.number(cs[1]) != 0)),
    "bid_le_ask": lambda cs, p, t: K.sure(K.number(cs[0]) > K.number(cs[1])),
    "repeated": lambda cs, p, t: K.repeated("_row_id", *cs),
    "monotonic": lambda cs, p, t: K.monotonic(cs[0], cs[1], "_row_id"),
    "year_between": lambda cs, p, t: K.sure(cs[0].isNotNull() & ~K.sure((K.number(cs[0]) % 1 == 0) & (K.number(cs[0]) >= 1900) & (K.number(cs[0]) <= F.year(t) + p.get("ahead", 1)))),
    "same_year": lambda cs, p, t: K.sure(F.year(K.day(cs[0])) != K.number(cs[1])),
    "school_window": lambda cs, p, t: K.sure((K.day(cs[0]) < F.make_date(K.number(cs[1]).cast("int") - 1, F.lit(7), F.lit(1))) | (K.day(cs[0]) > F.make_date(K.number(cs[1]).cast("int"), F.lit(6), F.lit(30)))),
    "only_when": lambda cs, p, t: cs[0].isNotNull() & ~K.sure(F.lower(cs[1].cast("string")).isin(*p["values"])),
    "requires": lambda cs, p, t: K.requires(cs[0], cs[1] if len(cs) > 1 else None),
    "bad_quality_value": lambda cs, p, t: K.sure((cs[0].isNull() | F.lower(cs[0]).isin(*p["values"])) & cs[1].isNotNull()),
    "map_consistency": lambda cs, p, t: K.sure(F.coalesce(*(F.when(K.number(cs[0]) == k, F.lower(cs[1]) != v) for k, v in p["map"].items()))),
    "gtin": lambda cs, p, t: K.any_of([c.isNotNull() & ~mod10_ok(c, tuple(p.get("lengths", (8, 12, 13, 14)))) for c in cs]),
}


def mod10_ok(c: Column, lengths: tuple[int, ...]) -> Column:
    from quartzite.functions.text import mod10

    return K.sure(mod10(c.cast("string"), lengths))


@dataclass(frozen=True)
class Pack:
    name: str
    rules: tuple[Rule, ...]
    aliases: dict[str, str] = field(default_factory=dict)
    coercions: dict[str, dict[str, str]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ids = [r.rule_id for r in self.rules]
        if len(set(ids)) < len(ids):
            raise ValueError(f"{self.name}: a rule id occurs twice")

    def detect(self, columns: list[str], given: dict[str, str] | None = None) -> dict[str, str]:
        """Field to column: given, exact, without regard to case, by alias pattern."""
        out = dict(given or {})
        fields = {f for r in self.rules for f in r.fields}
        for f in sorted(fields - set(out)):
            near = [c for c in columns if c == f] or [c for c in columns if c.lower() == f.lower()] or [c for c in columns if f in self.aliases and re.fullmatch(self.aliases[f], c, re.I)]
            if near:
                out[f] = near[0]
        return out


PACKS: dict[str, Pack] = {}


def register(pack: Pack) -> Pack:
    PACKS[pack.name] = pack
    return pack


def violations(pack: Pack, mapping: dict[str, str], as_of: Column) -> tuple[dict[str, Column], list[str]]:
    """Rule id to violation column; and the rules that are skipped, as a column is not there."""
    out, skipped = {}, []
    for r in sorted(pack.rules, key=lambda r: (LAYERS.index(r.layer), r.rule_id)):
        if all(f in mapping for f in r.fields):
            out[r.rule_id] = CHECKS[r.check]([q(mapping[f]) for f in r.fields], r.params, as_of)
        else:
            skipped.append(r.rule_id)
    return out, skipped


def validate(df: DataFrame, pack: Pack | str, mapping: dict[str, str] | None = None, as_of: str | None = None) -> dict:
    """Counts by rule, skipped rules and the pack's trust score; one job for all rules."""
    pack = PACKS[pack] if isinstance(pack, str) else pack
    fields = pack.detect(df.columns, mapping)
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    bad, skipped = violations(pack, fields, today)
    rows = df.withColumn("_row_id", F.monotonically_increasing_id()).select("*", *(v.alias(f"_v{i}") for i, v in enumerate(bad.values())))
    got = aggregate(rows, {("", "rows"): F.count(F.lit(1)), **{(r, "n"): F.count_if(F.col(f"_v{i}")) for i, r in enumerate(bad)}})
    n = got["", "rows"]
    by_id = {r.rule_id: r for r in pack.rules}
    counts = {r: got[r, "n"] for r in bad}
    absent = [r for r in skipped if by_id[r].check == "not_null"]
    loss = sum(WEIGHTS[by_id[r].severity] * min(c / n, 1) for r, c in counts.items()) if n else 0.0
    return {"domain": pack.name, "rows": n, "mapping": fields, "violations": counts, "skipped": skipped, "absent": absent, "trust": max(0.0, 1 - loss / max(1, len(pack.rules)))}


def flagged(df: DataFrame, pack: Pack | str, mapping: dict[str, str] | None = None, as_of: str | None = None) -> DataFrame:
    """``df`` with ``_violations``: the ids of the rules that a row violates."""
    pack = PACKS[pack] if isinstance(pack, str) else pack
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    bad, _ = violations(pack, pack.detect(df.columns, mapping), today)
    rows = df.withColumn("_row_id", F.monotonically_increasing_id())
    return rows.withColumn("_violations", F.array_compact(F.array(*(F.when(v, F.lit(r)) for r, v in bad.items())))).drop("_row_id")


def repaired(df: DataFrame, pack: Pack | str, mapping: dict[str, str] | None = None, as_of: str | None = None) -> DataFrame:
    """Repairs of the pack: rows rejected, defaults filled, values coerced by table; the rest is only flagged."""
    pack = PACKS[pack] if isinstance(pack, str) else pack
    fields = pack.detect(df.columns, mapping)
    today = F.lit(as_of).cast("date") if as_of else F.current_date()
    bad, _ = violations(pack, fields, today)
    new = {}
    out = df.withColumn("_row_id", F.monotonically_increasing_id())
    for r in pack.rules:
        if r.rule_id not in bad:
            continue
        action = r.repair.split(":")[0]
        if action == "reject":
            out = out.where(~bad[r.rule_id])
        elif action == "fill_default":
            for f in r.fields:
                if f in pack.defaults:
                    new[fields[f]] = F.coalesce(q(fields[f]), F.lit(pack.defaults[f]))
        elif action == "coerce":
            table = pack.coercions.get(r.repair.split(":")[1], {})
            for f in r.fields:
                c = q(fields[f])
                if table:
                    pairs = F.create_map(*(F.lit(x) for k, v in table.items() for x in (k.lower(), v)))
                    new[fields[f]] = F.coalesce(F.element_at(pairs, F.lower(F.trim(c))), c)
    return out.select(*(new[c].alias(c) if c in new else q(c) for c in df.columns))


# Rules of the packs.
register(Pack("agriculture", (
    Rule("AG-001", "schema", "error", ("field_id",), "not_null", repair="none"),
    Rule("AG-002", "format", "error", ("operation_date",), "iso_date"),
    Rule("AG-003", "format", "error", ("operation_date",), "not_future"),
    Rule("AG-006", "format", "error", ("area",), "positive"),
    Rule("AG-007", "reference", "error", ("area_unit",), "enum", {"values": ("ha", "acre", "m2", "km2"), "case_insensitive": True}, "coerce:unit"),
    Rule("AG-008", "business", "error", ("area", "area_unit"), "both_present"),
    Rule("AG-009", "format", "error", ("yield_value",), "positive"),
    Rule("AG-011", "business", "error", ("yield_value", "yield_unit"), "both_present"),
    Rule("AG-012", "business", "warning", ("yield_value", "operation_type"), "only_when", {"values": ("harvest", "harvesting")}),
    Rule("AG-014", "format", "error", ("soil_ph",), "range", {"min": 0.0, "max": 14.0}),
    Rule("AG-015", "semantic", "warning", ("soil_ph",), "range", {"min": 3.5, "max": 9.5}),
    Rule("AG-016", "format", "error", ("soil_om_pct",), "range", {"min": 0.0, "max": 100.0}),
    Rule("AG-017", "semantic", "warning", ("soil_om_pct",), "range", {"max": 20.0}),
    Rule("AG-018", "format", "error", ("season_year",), "year_between", {"ahead": 1}),
    Rule("AG-019", "business", "warning", ("operation_date", "season_year"), "same_year"),
), coercions={"unit": {"hectare": "ha", "hectares": "ha", "acres": "acre", "ac": "acre", "sqm": "m2"}}))
register(Pack("education", (
    Rule("ED-001", "schema", "error", ("student_unique_id",), "not_null", repair="none"),
    Rule("ED-002", "schema", "error", ("school_id", "school_year"), "not_null", repair="none"),
    Rule("ED-003", "format", "error", ("school_year",), "year_between", {"ahead": 2}),
    Rule("ED-005", "format", "error", ("enrollment_date",), "iso_date"),
    Rule("ED-006", "format", "error", ("exit_withdrawal_date",), "iso_date"),
    Rule("ED-007", "business", "error", ("exit_withdrawal_date", "enrollment_date"), "date_order"),
    Rule("ED-008", "business", "warning", ("enrollment_date", "school_year"), "school_window"),
    Rule("ED-010", "business", "error", ("exit_withdrawal_date", "exit_withdrawal_type"), "requires"),
    Rule("ED-011", "schema", "error", ("assessment_title", "assessment_score"), "both_present"),
    Rule("ED-012", "format", "error", ("assessment_score",), "numeric"),
    Rule("ED-014", "semantic", "warning", ("assessment_score",), "nonneg"),
)))
register(Pack("energy", (
    Rule("ENG-001", "schema", "error", ("timestamp",), "not_null", repair="none"),
    Rule("ENG-002", "schema", "error", ("asset_id",), "not_null", repair="none"),
    Rule("ENG-003", "format", "error", ("timestamp",), "iso_datetime", repair="none"),
    Rule("ENG-004", "format", "warning", ("timestamp",), "not_future", repair="none"),
    Rule("ENG-005", "format", "error", ("register_address",), "range", {"min": 0, "max": 65535}),
    Rule("ENG-006", "format", "error", ("function_code",), "enum", {"values": (1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 15, 16, 17, 20, 21, 22, 23, 24, 43)}),
    Rule("ENG-007", "format", "warning", ("value",), "numeric"),
    Rule("ENG-008", "reference", "error", ("quality",), "enum", {"values": ("good", "bad", "uncertain", "stale"), "case_insensitive": True}, "coerce:quality"),
    Rule("ENG-010", "business", "warning", ("asset_id", "register_address", "timestamp"), "repeated"),
    Rule("ENG-011", "business", "warning", ("function_code", "object_type"), "map_consistency", {"map": {1: "coil", 2: "discrete_input", 3: "holding_register", 4: "input_register", 5: "coil", 6: "holding_register", 15: "coil", 16: "holding_register"}}),
    Rule("ENG-012", "semantic", "info", ("quality", "value"), "bad_quality_value", {"values": ("bad", "stale")}, "none"),
), coercions={"quality": {"ok": "good", "valid": "good", "invalid": "bad", "error": "bad", "suspect": "uncertain", "old": "stale"}}))
register(Pack("finance", (
    Rule("FIN-001", "schema", "error", ("transaction_id",), "not_null", repair="none"),
    Rule("FIN-002", "schema", "error", ("date", "debit", "credit", "currency"), "not_null", repair="none"),
    Rule("FIN-003", "format", "error", ("date",), "iso_date"),
    Rule("FIN-004", "format", "error", ("debit", "credit"), "two_decimals"),
    Rule("FIN-005", "reference", "error", ("currency",), "regex", {"pattern": "[A-Z]{3}"}),
    Rule("FIN-006", "business", "error", ("transaction_id", "debit", "credit"), "balanced", {"tolerance": 0.01}),
    Rule("FIN-007", "business", "warning", ("debit", "credit"), "not_both_sided"),
    Rule("FIN-008", "format", "warning", ("account_code",), "regex", {"pattern": "[A-Za-z0-9]{4,12}"}),
    Rule("FIN-009", "semantic", "warning", ("date",), "not_future"),
), aliases={"transaction_id": r"txn_?id|trans(?:action)?_?id", "account_code": r"acc(?:oun)?t(?:_?code)?"}))
register(Pack("finance_tick", (
    Rule("FIN-T-001", "schema", "error", ("timestamp",), "not_null", repair="none"),
    Rule("FIN-T-002", "schema", "error", ("symbol",), "not_null", repair="none"),
    Rule("FIN-T-003", "format", "error", ("timestamp",), "iso_datetime", repair="none"),
    Rule("FIN-T-004", "format", "warning", ("timestamp",), "not_future", repair="none"),
    Rule("FIN-T-005", "format", "error", ("price",), "positive"),
    Rule("FIN-T-006", "format", "error", ("size",), "positive"),
    Rule("FIN-T-008", "business", "warning", ("bid", "ask"), "bid_le_ask"),
    Rule("FIN-T-009", "business", "warning", ("symbol", "timestamp", "price", "size"), "repeated"),
    Rule("FIN-T-010", "semantic", "info", ("currency", "exchange"), "not_null", repair="none"),
)))
register(Pack("retail", (
    Rule("RT-001", "schema", "error", ("gtin",), "not_null", repair="none"),
    Rule("RT-002", "format", "error", ("gtin",), "gtin"),
    Rule("RT-003", "format", "error", ("gln",), "gtin", {"lengths": (13,)}),
    Rule("RT-004", "business", "warning", ("net_content", "net_content_uom"), "both_present"),
), aliases={"gtin": r"upc|ean|barcode"}))


def validate_feed(frames: dict[str, DataFrame], packs: dict[str, str], references: list[tuple[str, str, str, str]] = (), as_of: str | None = None) -> dict:
    """Reports of a feed of named frames, and the rows of each reference (file, field, target file, target field) that has no target."""
    out = {name: validate(df, packs[name], as_of=as_of) for name, df in frames.items() if name in packs}
    orphans = {}
    for file, column, target, target_column in references:
        if file in frames and target in frames:
            known = frames[target].select(q(target_column).alias("_known")).distinct()
            orphans[file, column] = frames[file].where(q(column).isNotNull()).join(known, q(column) == F.col("_known"), "left_anti").count()
    return {"frames": out, "orphans": orphans}


from quartzite.plans import domain_packs  # noqa: E402, F401  the packs register themselves
