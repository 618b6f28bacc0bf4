"""Packs for transport feeds, media catalogues and health records. The rules and code lists are fixed values of public standards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quartzite.functions import checks as K
from quartzite.functions.text import mod10
from quartzite.plans.domains import CHECKS, Pack, Rule, register


def eidr(c: Column) -> Column:
    shape = r"^10\.5240/(?:[0-9A-F]{4}-){5}[0-9A-Z*]\z"
    code = F.regexp_replace(F.substring(c, 9, 99), "-", "")
    return K.sure(c.rlike(shape) & (K.mod37_2(F.substring(code, 1, 20)) == F.substring(code, 21, 1)))


def icpn(c: Column) -> Column:
    return K.sure(mod10(F.regexp_replace(c.cast("string"), "[^0-9]", ""), (12, 13)))


def clock(c: Column) -> Column:
    return K.clock_seconds(c.cast("string"))


CHECKS.update(
    {
        "gtfs_time": lambda cs, p, t: K.any_of([c.isNotNull() & clock(c).isNull() for c in cs]),
        "clock_order": lambda cs, p, t: K.sure(clock(cs[1]) < clock(cs[0])),
        "eidr": lambda cs, p, t: K.any_of([c.isNotNull() & ~eidr(c.cast("string")) for c in cs]),
        "icpn": lambda cs, p, t: K.any_of([c.isNotNull() & ~icpn(c) for c in cs]),
        "requires_when": lambda cs, p, t: K.requires_when(cs[0], p["values"], cs[1]),
        "no_episode": lambda cs, p, t: K.sure(F.lower(cs[0]).isin(*p["values"])) & (cs[1].isNotNull() | cs[2].isNotNull()),
        "count_when": lambda cs, p, t: K.sure((F.lower(cs[0]) == p["value"]) & ~K.number(cs[1]).between(p["min"], p["max"])),
        "age_range": lambda cs, p, t: K.sure(~(F.datediff(t, K.day(cs[0])) / 365.25).between(0, p["max"])),
        "duration_when": lambda cs, p, t: K.sure((F.lower(cs[0]) == p["value"]) & (F.datediff(K.day(cs[2]), K.day(cs[1])) >= p["days"])),
        "not_future_when": lambda cs, p, t: K.sure(F.lower(cs[0]) == p["value"]) & K.not_future(t, *cs[1:]),
        "pattern_when": lambda cs, p, t: K.sure(F.lower(cs[1]).contains(p["system"])) & K.regex(p["pattern"], cs[0]),
    }
)

register(Pack("gtfs_stops", (
    Rule("GTFS-S001", "schema", "error", ("stop_id", "stop_lat", "stop_lon"), "not_null", repair="none"),
    Rule("GTFS-S002", "format", "error", ("stop_lat",), "range", {"min": -90, "max": 90}),
    Rule("GTFS-S003", "format", "error", ("stop_lon",), "range", {"min": -180, "max": 180}),
    Rule("GTFS-S004", "business", "error", ("stop_id",), "unique"),
)))
register(Pack("gtfs_routes", (
    Rule("GTFS-R001", "schema", "error", ("route_id", "route_type"), "not_null", repair="none"),
    Rule("GTFS-R002", "reference", "error", ("route_type",), "enum", {"values": (0, 1, 2, 3, 4, 5, 6, 7, 11, 12)}),
    Rule("GTFS-R003", "business", "error", ("route_id",), "unique"),
)))
register(Pack("gtfs_trips", (
    Rule("GTFS-T001", "schema", "error", ("route_id", "service_id", "trip_id"), "not_null", repair="none"),
    Rule("GTFS-T002", "business", "error", ("trip_id",), "unique"),
)))
register(Pack("gtfs_stop_times", (
    Rule("GTFS-ST002", "format", "error", ("arrival_time", "departure_time"), "gtfs_time"),
    Rule("GTFS-ST003", "business", "error", ("arrival_time", "departure_time"), "clock_order"),
    Rule("GTFS-ST004", "business", "error", ("trip_id", "stop_sequence"), "monotonic"),
)))
register(Pack("media_content", (
    Rule("MD-C001", "schema", "error", ("eidr_id",), "not_null", repair="none"),
    Rule("MD-C002", "format", "error", ("eidr_id",), "eidr"),
    Rule("MD-C007", "format", "error", ("runtime_seconds",), "positive_integer"),
    Rule("MD-C008", "semantic", "warning", ("runtime_seconds",), "range", {"max": 86400}),
    Rule("MD-C009", "business", "error", ("content_type", "series_eidr_id"), "requires_when", {"values": ("episode",)}),
    Rule("MD-C010", "business", "error", ("series_eidr_id",), "eidr"),
    Rule("MD-C011", "business", "error", ("season_number", "episode_number"), "positive_integer"),
    Rule("MD-C012", "business", "error", ("episode_number", "season_number"), "requires"),
    Rule("MD-C013", "business", "warning", ("content_type", "season_number", "episode_number"), "no_episode", {"values": ("movie", "short")}),
)))
register(Pack("media_release", (
    Rule("MD-R001", "schema", "error", ("release_id",), "not_null", repair="none"),
    Rule("MD-R002", "format", "error", ("icpn",), "icpn"),
    Rule("MD-R007", "format", "error", ("release_date",), "iso_date"),
    Rule("MD-R008", "format", "error", ("track_count",), "positive_integer"),
    Rule("MD-R009", "semantic", "warning", ("track_count",), "range", {"max": 500}),
    Rule("MD-R010", "business", "error", ("party_role", "party_id"), "requires"),
    Rule("MD-R011", "business", "warning", ("release_type", "track_count"), "count_when", {"value": "single", "min": 1, "max": 3}),
)))
register(Pack("health_patient", (
    Rule("HC-P001", "schema", "error", ("patient_id",), "not_null", repair="none"),
    Rule("HC-P002", "schema", "error", ("birth_date", "gender"), "not_null", repair="none"),
    Rule("HC-P003", "format", "error", ("birth_date",), "fhir_date"),
    Rule("HC-P003I", "format", "info", ("birth_date",), "partial_date"),
    Rule("HC-P004", "format", "error", ("birth_date",), "not_future"),
    Rule("HC-P005", "reference", "error", ("gender",), "enum", {"values": ("male", "female", "other", "unknown")}, "coerce:gender"),
    Rule("HC-P006", "business", "error", ("deceased_date", "birth_date"), "date_order"),
    Rule("HC-P007", "business", "error", ("deceased_date",), "not_future"),
    Rule("HC-P009", "semantic", "warning", ("birth_date",), "age_range", {"max": 150}),
), coercions={"gender": {"male": "male", "female": "female", "other": "other", "unknown": "unknown", "m": "male", "f": "female"}}))
register(Pack("health_encounter", (
    Rule("HC-E001", "schema", "error", ("encounter_id", "patient_id", "status"), "not_null", repair="none"),
    Rule("HC-E002", "reference", "error", ("status",), "enum", {"values": ("planned", "arrived", "triaged", "in-progress", "onleave", "finished", "cancelled", "entered-in-error", "unknown")}),
    Rule("HC-E003", "reference", "error", ("class_code",), "enum", {"values": ("AMB", "EMER", "FLD", "HH", "IMP", "ACUTE", "NONAC", "OBSENC", "PRENC", "SS", "VR")}),
    Rule("HC-E004", "format", "error", ("period_start", "period_end"), "iso_datetime"),
    Rule("HC-E005", "business", "error", ("period_end", "period_start"), "date_order"),
    Rule("HC-E006", "business", "error", ("status", "period_start", "period_end"), "not_future_when", {"value": "finished"}),
    Rule("HC-E008", "semantic", "warning", ("status", "period_start", "period_end"), "duration_when", {"value": "finished", "days": 365}),
)))
register(Pack("health_observation", (
    Rule("HC-O001", "schema", "error", ("observation_id", "patient_id", "status", "code_value"), "not_null", repair="none"),
    Rule("HC-O002", "reference", "error", ("status",), "enum", {"values": ("registered", "preliminary", "final", "amended", "corrected", "cancelled", "entered-in-error", "unknown")}),
    Rule("HC-O005", "format", "error", ("effective_date",), "iso_datetime"),
    Rule("HC-O006", "business", "warning", ("value_quantity", "value_string"), "at_least_one"),
    Rule("HC-O007", "business", "error", ("value_quantity", "value_unit"), "requires"),
    Rule("HC-O008", "format", "error", ("value_quantity",), "nonneg_number"),
    Rule("HC-O009", "reference", "error", ("interpretation",), "enum", {"values": ("H", "L", "N", "A", "AA", "HH", "LL", "U", "R", "S", "I")}),
)))
register(Pack("health_condition", (
    Rule("HC-C001", "schema", "error", ("condition_id",), "not_null", repair="none"),
    Rule("HC-C002", "schema", "error", ("patient_id",), "not_null", repair="none"),
    Rule("HC-C003", "schema", "error", ("code_value",), "not_null", repair="none"),
    Rule("HC-C004", "reference", "warning", ("clinical_status",), "enum", {"values": ("active", "recurrence", "relapse", "inactive", "remission", "resolved"), "case_insensitive": True}),
    Rule("HC-C005", "reference", "warning", ("code_value", "code_system"), "pattern_when", {"system": "icd-10", "pattern": r"[A-Z][0-9][0-9A-Z](?:\.[0-9A-Z]{1,4})?"}),
    Rule("HC-C006", "format", "warning", ("onset_date",), "fhir_date"),
)))
register(Pack("health_medication", (
    Rule("HC-M001", "schema", "error", ("medication_request_id",), "not_null", repair="none"),
    Rule("HC-M002", "schema", "error", ("patient_id",), "not_null", repair="none"),
    Rule("HC-M003", "reference", "error", ("status",), "enum", {"values": ("active", "on-hold", "cancelled", "completed", "entered-in-error", "stopped", "draft", "unknown"), "case_insensitive": True}),
    Rule("HC-M004", "reference", "error", ("intent",), "enum", {"values": ("proposal", "plan", "order", "original-order", "reflex-order", "filler-order", "instance-order", "option"), "case_insensitive": True}),
    Rule("HC-M005", "schema", "warning", ("medication_code",), "not_null", repair="none"),
    Rule("HC-M006", "format", "warning", ("authored_on",), "fhir_date"),
)))
