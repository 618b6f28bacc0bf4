import json

import pytest
from pyspark.sql import functions as F

from quartzite.functions import text as X
from quartzite.operators import privacy, quality
from quartzite.operators.values import MaskRule
from quartzite.plans import cleaning, domains, lineage
from quartzite.plans.config import CleanOptions
from quartzite.sources import parsers, tables
from quartzite.streaming.cleaner import Moments, StreamCleaner, StreamOptions


def test_names():
    assert X.clean_names(["CustomerID", "HTTPServer v2", "a b", "A-B", "", "a_b_2"]) == ["customer_id", "http_server_v2", "a_b", "a_b_3", "column_4", "a_b_2"]


def test_options():
    with pytest.raises(TypeError, match="did you mean 'impute'"):
        CleanOptions.of(imputee="mean")
    with pytest.raises(ValueError):
        CleanOptions(strategy="x")


@pytest.fixture(scope="module")
def messy(spark):
    rows = [(i, f" name{i} " if i % 3 else "N/A", None if i % 20 == 0 else float(i % 50), "yes" if i % 2 else "no", f"{i}") for i in range(100)]
    return spark.createDataFrame(rows + rows[:10], "RowID long, Name string, Val double, Flag string, Num string")


def test_clean(messy):
    out, report = cleaning.clean(messy)
    assert out.columns[:5] == ["row_id", "name", "val", "flag", "num"]
    assert dict(out.dtypes)["flag"] == "boolean" and dict(out.dtypes)["num"] == "bigint"
    assert out.count() == 100 and out.where("val is null").count() == 0
    counts = {(a.step, a.column): a.count for a in report.actions}
    assert counts["drop_duplicates", None] == 10 and counts["normalize_sentinels", "name"] == 38
    again, second = cleaning.clean(out)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))
    shuffled, _ = cleaning.clean(messy.repartition(7))
    assert sorted(map(str, shuffled.collect())) == sorted(map(str, out.collect()))
    assert json.loads(report.to_json())["rows_before"] == 110


def test_jobs_do_not_grow_with_columns(spark, messy):
    def jobs(df):
        group = f"g{len(df.columns)}"
        spark.sparkContext.setJobGroup(group, group)
        cleaning.clean(df, drop_duplicates=False)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    wide = messy.select("*", *(F.col("Val").alias(f"v{i}") for i in range(8)))
    assert jobs(wide) <= jobs(messy) + 4


def test_privacy(spark):
    df = spark.createDataFrame([(1, "mail bob@x.org, SSN 123-45-6789", "Ann"), (2, "card 4111 1111 1111 1111", "Bo"), (3, None, None)], "id long, note string, full_name string")
    got = {(r.id, r.entity_type) for r in privacy.detect(df, "id").collect()}
    assert {("1", "EMAIL"), ("1", "SSN"), ("2", "CREDIT_CARD")} <= got
    clean = privacy.anonymize(df, [MaskRule("redact", ("full_name",))], privacy.Detection()).orderBy("id").collect()
    assert clean[0].note == "mail <EMAIL>, SSN <SSN>" and clean[0].full_name == "[REDACTED]" and clean[2].note is None
    out, info = privacy.apply_policy(df, privacy.PACKS["hipaa"])
    assert info["columns"]["full_name"][1] == "redact" and info["score"] == 100.0
    assert out.where("full_name = '[REDACTED]'").count() == 2


def test_parsers(spark):
    bundle = json.dumps({"resourceType": "Bundle", "entry": [{"resource": {"resourceType": "Patient", "id": "p1", "gender": "female", "name": [{"family": "Roe", "given": ["Jo"]}]}}, {"resource": {"resourceType": "Device", "id": "d"}}, {"resource": {"resourceType": "Observation", "id": "o1", "subject": {"reference": "Patient/p1"}, "valueQuantity": {"value": 5.5, "unit": "mg"}}}]})
    f = parsers.parse(parsers.texts(spark, [bundle]), "fhir")
    assert f["patient"].first().family == "Roe" and f["observation"].first().unit == "mg" and f["unsupported"].first()["count"] == 1
    hl7 = "MSH|^~\\&|A\rPID|1||77^^^H||Doe^Jane||19800101|F\rOBR|1||ord9|GLU^Glucose\rOBX|1|NM|GLU^Glucose||5.4|mmol/L|||||F\rMSH|^~\\&|B\rOBX|1|NM|X^Y||1|u"
    obs = parsers.parse(parsers.texts(spark, [hl7]), "hl7v2")["observation"].orderBy("part").collect()
    assert (obs[0].patient_id, obs[0].order_id, obs[0].value) == ("77", "ord9", "5.4") and obs[1].patient_id is None
    e = parsers.parse(parsers.texts(spark, ["UNA:+.? 'UNH+1+ORDERS:D'FTX+a?+b?'c:d'"]), "edifact")
    assert [r.value for r in e["elements"].where("tag = 'FTX'").orderBy("i", "j").collect()] == ["a+b'c", "d"] and e["segments"].count() == 2
    g = parsers.parse(parsers.texts(spark, ['<gpx><wpt lat="1.5" lon="2"><name>A</name></wpt><wpt lat="x" lon="2"/><trk><trkseg><trkpt lat="3" lon="4"><ele>9</ele></trkpt></trkseg></trk></gpx>']), "gpx")
    assert g["waypoints"].first().name == "A" and g["track_points"].first().ele == 9.0 and g["bad_points"].where("table = 'waypoints'").first().n == 1
    s = parsers.parse(parsers.texts(spark, ['<Series FREQ="A"><Obs TIME_PERIOD="2020" OBS_VALUE="1.5"/></Series>']), "sdmx")["observations"].first()
    assert s.keys == {"FREQ": "A"} and s.period == "2020" and s.value == 1.5
    with pytest.raises(ValueError):
        parsers.get_parser("nope")


def test_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value", "event_type")
    events.repartition(4).write.parquet(f"{tmp_path}/in")
    cleaner, out = StreamCleaner(stream=StreamOptions(least_trust=50.0)), []
    query = tables.stream_files(spark, f"{tmp_path}/in", events.schema).writeStream.foreachBatch(cleaner.as_sink(lambda df, i: out.append(df.count()))).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    want = events.agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.count("value").alias("n")).first()
    m = cleaner.columns["value"].moments
    assert m.n == want.n and abs(m.mean - want.m) < 1e-6 and abs(m.std - want.s) < 1e-6
    assert sum(out) == events.count() and cleaner.finalize()["batches"] == len(out)
    again = StreamCleaner.from_json(cleaner.state_json())
    assert again.process(events, min(cleaner.done)) is None and again.columns["value"].moments == m


def test_moments_merge():
    a = Moments()
    for part in ([1.0, 2.0], [3.0, 4.0, 10.0]):
        mean = sum(part) / len(part)
        a.merge(len(part), mean, sum((x - mean) ** 2 for x in part) / len(part))
    assert a.n == 5 and a.mean == 4.0 and abs(a.m2 - 50.0) < 1e-9


def test_domains_and_lineage(spark, messy):
    df = spark.createDataFrame([("F1", "2024-05-01", 2.0, "acres"), (None, "2024-13-01", -1.0, None)], "field_id string, operation_date string, area double, area_unit string")
    got = domains.validate(df, "agriculture", as_of="2025-01-01")
    assert {k: v for k, v in got["violations"].items() if v} == {"AG-001": 1, "AG-002": 1, "AG-006": 1, "AG-007": 1, "AG-008": 1}
    assert domains.repaired(df, "agriculture").first().area_unit == "acre"
    assert domains.flagged(df, "agriculture", as_of="2025-01-01").where("size(_violations) = 0").count() == 0
    t = lineage.Lineage("job")
    out, report = cleaning.clean(messy)
    t.record("clean", messy, out)
    assert [e["eventType"] for e in t.openlineage()] == ["START", "COMPLETE"]
    assert lineage.fingerprint(messy) == lineage.fingerprint(messy.repartition(5)) != lineage.fingerprint(out)
    assert {r["status"] for r in lineage.compliance("alcoa", report, out.columns)} <= {"met", "open"}
    contract = {"val": quality.ColumnContract(nullable=False, minimum=0)}
    assert lineage.expectation_suite("s", contract)["expectations"][0]["kwargs"] == {"column": "val"}
    assert quality.drift(messy, quality.baseline(messy)) == []


def test_read_write(spark, messy, tmp_path):
    tables.write(messy, f"{tmp_path}/x.csv")
    back = tables.read(spark, f"{tmp_path}/x.csv")
    assert back.count() == 110 and {t for _, t in back.dtypes} == {"string"}
    from quartzite.cli import main

    assert main(["trust", f"{tmp_path}/x.csv", "--threshold", "10"], spark) == 0
