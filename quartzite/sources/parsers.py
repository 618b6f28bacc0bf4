"""Parsers of domain formats: each turns texts into named frames, as DataFrame expressions over whole messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Frames = dict[str, DataFrame]
PARSERS: dict[str, Callable[[DataFrame], Frames]] = {}


def parser(name: str):
    def add(fn):
        PARSERS[name] = fn
        return fn

    return add


def get_parser(name: str) -> Callable[[DataFrame], Frames]:
    try:
        return PARSERS[name.lower()]
    except KeyError:
        raise ValueError(f"no parser for {name!r}; there are {', '.join(sorted(PARSERS))}") from None


def messages(spark: SparkSession, path: str) -> DataFrame:
    """message_id and text: a row for each file."""
    return spark.read.option("wholetext", True).text(path).select(F.monotonically_increasing_id().alias("message_id"), F.col("value").alias("text"))


def texts(spark: SparkSession, values: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(values)), "message_id long, text string")


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("r", path, kind)


@parser("fhir")
def fhir(df: DataFrame) -> Frames:
    """A bundle, one resource or a list of them; other resource types are counted."""
    v = df.select("message_id", F.try_parse_json("text").alias("v")).where("v is not null")
    entries = F.coalesce(F.try_variant_get("v", "$.entry", "array<struct<resource:variant>>").getField("resource"), F.try_variant_get("v", "$", "array<variant>"), F.array(F.col("v")))
    rows = v.select("message_id", F.explode(entries).alias("r")).withColumn("kind", _get("$.resourceType"))
    of = lambda kind, **fields: rows.where(F.col("kind") == kind).select("message_id", *(_get(p).alias(n) for n, p in fields.items()))
    return {
        "patient": of("Patient", patient_id="$.id", family="$.name[0].family", given="$.name[0].given[0]", gender="$.gender", birth_date="$.birthDate", deceased="$.deceasedBoolean"),
        "observation": of("Observation", observation_id="$.id", patient_id="$.subject.reference", status="$.status", code_system="$.code.coding[0].system", code_value="$.code.coding[0].code", value="$.valueQuantity.value", unit="$.valueQuantity.unit", effective="$.effectiveDateTime"),
        "encounter": of("Encounter", encounter_id="$.id", patient_id="$.subject.reference", status="$.status", class_code="$.class.code", period_start="$.period.start", period_end="$.period.end"),
        "condition": of("Condition", condition_id="$.id", patient_id="$.subject.reference", clinical_status="$.clinicalStatus.coding[0].code", code_system="$.code.coding[0].system", code_value="$.code.coding[0].code", onset_date="$.onsetDateTime"),
        "medication_request": of("MedicationRequest", medication_request_id="$.id", patient_id="$.subject.reference", status="$.status", intent="$.intent", medication_code="$.medicationCodeableConcept.coding[0].code"),
        "unsupported": rows.where(~F.col("kind").isin("Patient", "Observation", "Encounter", "Condition", "MedicationRequest") | F.col("kind").isNull()).groupBy("kind").count(),
    }


@parser("hl7v2")
def hl7v2(df: DataFrame) -> Frames:
    """Segments of v2 messages; the patient and the order of a segment are the last ones before it in its message."""
    lines = df.select("message_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "line")).where(F.trim("line") != "")
    seg = lines.select("message_id", "pos", F.split("line", r"\|", -1).alias("f")).withColumn("seg", F.col("f")[0])
    w = Window.partitionBy("message_id").orderBy("pos")
    seg = seg.withColumn("part", F.sum((F.col("seg") == "MSH").cast("int")).over(w))
    inside = Window.partitionBy("message_id", "part").orderBy("pos")
    field = lambda i: F.get("f", F.lit(i))
    sub = lambda i, j: F.get(F.split(field(i), r"\^", -1), F.lit(j - 1))
    seg = seg.withColumns({"patient_id": F.last(F.when(F.col("seg") == "PID", sub(3, 1)), True).over(inside), "order_id": F.last(F.when(F.col("seg") == "OBR", field(3)), True).over(inside)})
    of = lambda name, *columns: seg.where(F.col("seg") == name).select("message_id", "part", *columns)
    return {
        "patient": of("PID", "patient_id", sub(5, 1).alias("family"), sub(5, 2).alias("given"), field(7).alias("birth_date"), field(8).alias("gender")),
        "encounter": of("PV1", "patient_id", field(2).alias("class_code"), sub(3, 1).alias("ward"), sub(19, 1).alias("visit_id")),
        "order": of("OBR", "patient_id", "order_id", sub(4, 1).alias("code"), sub(4, 2).alias("name"), field(7).alias("observed_at")),
        "observation": of("OBX", "patient_id", "order_id", field(2).alias("value_type"), sub(3, 1).alias("code"), sub(3, 2).alias("name"), field(5).alias("value"), field(6).alias("unit"), field(11).alias("status")),
    }


@parser("edifact")
def edifact(df: DataFrame) -> Frames:
    """Segments and elements, with the delimiters of a UNA header; a release character takes the one after it as it is."""
    una = F.col("text").startswith("UNA")
    ch = lambda i, default: F.when(una, F.substring("text", 3 + i, 1)).otherwise(F.lit(default))
    quoted = lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))
    rows = df.select("message_id", ch(1, ":").alias("part"), ch(2, "+").alias("element"), ch(4, "?").alias("release"), ch(6, "'").alias("segment"), F.when(una, F.substring("text", 10, 1 << 30)).otherwise(F.col("text")).alias("body"))
    # released characters are put aside as private-use code points, so that splitting is plain
    for i, name in enumerate(("release", "part", "element", "segment")):
        rows = rows.withColumn("body", F.replace("body", F.concat(F.col("release"), F.col(name)), F.lit(chr(0xE000 + i))))

    def restored(c: Column) -> Column:
        for i, name in enumerate(("release", "part", "element", "segment")):
            c = F.replace(c, F.lit(chr(0xE000 + i)), F.col(name))
        return c

    seg = rows.select("*", F.posexplode(F.split("body", quoted(F.col("segment")))).alias("pos", "raw")).withColumn("raw", F.regexp_replace("raw", r"^[\r\n\s]+", "")).where("raw <> ''")
    elements = seg.select("*", F.split("raw", quoted(F.col("element")), F.lit(-1)).alias("e"))
    segments = elements.select("message_id", "pos", restored(F.col("e")[0]).alias("tag"), (F.size("e") - 1).alias("n_elements"))
    cells = elements.select("*", F.posexplode("e").alias("i", "v")).where("i > 0")
    cells = cells.select("message_id", "pos", restored(F.col("e")[0]).alias("tag"), "i", "part", "element", "release", "segment", F.posexplode(F.split("v", quoted(F.col("part")), F.lit(-1))).alias("j", "x"))
    return {"segments": segments, "elements": cells.select("message_id", "pos", "tag", "i", "j", restored(F.col("x")).alias("value"))}


@parser("gpx")
def gpx(df: DataFrame) -> Frames:
    """Waypoints, route points and track points; points without numeric coordinates are left out and counted."""

    def points(tag: str) -> DataFrame:
        found = df.select("message_id", F.posexplode(F.regexp_extract_all("text", F.lit(rf"(?s)<{tag}\b[^>]*?(?:/>|>.*?</{tag}>)"), F.lit(0))).alias("pos", "x"))
        attr = lambda n: F.regexp_extract("x", rf'\b{n}\s*=\s*["\']([^"\']*)["\']', 1).try_cast("double").alias(n)
        child = lambda n: F.nullif(F.regexp_extract("x", rf"(?s)<{n}>\s*(.*?)\s*</{n}>", 1), F.lit("")).alias(n)
        return found.select("message_id", "pos", attr("lat"), attr("lon"), child("ele").try_cast("double").alias("ele"), child("time"), child("name"))

    good = F.coalesce(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180), F.lit(False))
    tables = {"waypoints": points("wpt"), "route_points": points("rtept"), "track_points": points("trkpt")}
    bad = None
    for name, t in tables.items():
        part = t.where(~good).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        bad = part if bad is None else bad.unionByName(part)
    return {name: t.where(good) for name, t in tables.items()} | {"bad_points": bad}


@parser("sdmx")
def sdmx(df: DataFrame) -> Frames:
    """Observations in long form: the series' keys as a map, period and value; generic and attribute style."""
    series = df.select("message_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?s)<(?:\w+:)?Series\b.*?</(?:\w+:)?Series>"), F.lit(0))).alias("series", "x"))
    pairs = lambda text: F.regexp_extract_all(text, F.lit(r'(\w+)\s*=\s*"([^"]*)"'), F.lit(1))
    values = lambda text: F.regexp_extract_all(text, F.lit(r'(\w+)\s*=\s*"([^"]*)"'), F.lit(2))
    head = F.regexp_extract("x", r"(?s)<(?:\w+:)?Series\b([^>]*)>", 1)
    generic = F.regexp_extract("x", r"(?s)<(?:\w+:)?SeriesKey>(.*?)</(?:\w+:)?SeriesKey>", 1)
    ids = F.regexp_extract_all(generic, F.lit(r'<(?:\w+:)?Value\b[^>]*\bid="([^"]*)"[^>]*\bvalue="([^"]*)"'), F.lit(1))
    vals = F.regexp_extract_all(generic, F.lit(r'<(?:\w+:)?Value\b[^>]*\bid="([^"]*)"[^>]*\bvalue="([^"]*)"'), F.lit(2))
    keys = F.when(generic != "", F.map_from_arrays(ids, vals)).otherwise(F.map_from_arrays(pairs(head), values(head)))
    obs = series.select("message_id", "series", keys.alias("keys"), F.explode(F.regexp_extract_all("x", F.lit(r"(?s)<(?:\w+:)?Obs\b[^>]*?(?:/>|>.*?</(?:\w+:)?Obs>)"), F.lit(0))).alias("o"))
    first = lambda *ps: F.coalesce(*(F.nullif(F.regexp_extract("o", p, 1), F.lit("")) for p in ps))
    return {"observations": obs.select("message_id", "series", "keys", first(r'\bTIME_PERIOD="([^"]*)"', r'<(?:\w+:)?ObsDimension\b[^>]*\bvalue="([^"]*)"').alias("period"), first(r'\bOBS_VALUE="([^"]*)"', r'<(?:\w+:)?ObsValue\b[^>]*\bvalue="([^"]*)"').try_cast("double").alias("value"))}


def parse(df: DataFrame, fmt: str) -> Frames:
    return get_parser(fmt)(df)


def parse_and_clean(df: DataFrame, fmt: str, frame: str | None = None, **options):
    """Parse, take the named frame (or the only one with rows) and clean it."""
    from quartzite.plans.cleaning import clean

    frames = parse(df, fmt)
    if frame is None:
        full = [k for k, v in frames.items() if v.limit(1).count()]
        if len(full) != 1:
            raise ValueError(f"frames with rows: {full}; name one")
        frame = full[0]
    return clean(frames[frame], **options)
