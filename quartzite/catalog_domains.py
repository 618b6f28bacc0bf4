"""Registered queries of the domain packs: each pack over a view of the tables with faults of every kind, and each rule in DuckDB SQL.

A view is the same SQL in both engines; the conditions are written anew, from what a rule says.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzite.plans import domains

AS_OF = "1997-06-01"
DAY = lambda c: f"TRY_CAST(substring({c}, 1, 10) AS DATE)"
NO_DAY = lambda c: f"{c} IS NOT NULL AND TRY_CAST({c} AS DATE) IS NULL"
FUTURE = lambda c: f"{DAY(c)} > DATE '{AS_OF}'"
BELOW = lambda c, x=0: f"{c} <= {x}"
ONE_OF = lambda c, *vs: f"{c} NOT IN ({', '.join(repr(v) for v in vs)})"
ONE_NULL = lambda a, b: f"({a} IS NULL) <> ({b} IS NULL)"
#: The order's or line's day as text, with some that are none.
ORDER_DAY = "CASE WHEN o_orderkey % 17 = 0 THEN '1996-13-01' WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END"
SHIP_DAY = "CASE WHEN l_orderkey % 17 = 0 THEN '1996-02-30' WHEN l_orderkey % 23 = 0 THEN NULL ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END"
RECEIPT_DAY = "CASE l_partkey % 4 WHEN 0 THEN '1992-01-01' WHEN 1 THEN '1999-12-31' WHEN 2 THEN NULL ELSE '1996-06-30' END"

#: Pack -> (table, view, rule -> condition of a violation).
PACKS: dict[str, tuple[str, str, dict[str, str]]] = {
    "agriculture": (
        "orders",
        f"""SELECT CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE 'F' || CAST(o_custkey AS STRING) END AS field_id, {ORDER_DAY} AS operation_date,
        CASE WHEN o_orderkey % 13 = 0 THEN -1 WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_custkey END AS area, CASE o_orderkey % 7 WHEN 0 THEN 'HA' WHEN 1 THEN 'acre' WHEN 2 THEN 'bushel' WHEN 3 THEN NULL ELSE 'ha' END AS area_unit,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 0 ELSE o_custkey END AS yield_value, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE 't' END AS yield_unit,
        CASE o_custkey % 4 WHEN 0 THEN 'Harvest' WHEN 1 THEN 'planting' WHEN 2 THEN 'harvesting' ELSE NULL END AS operation_type,
        o_orderkey % 16 - 1 AS soil_ph, o_custkey % 120 - 5 AS soil_om_pct, CASE WHEN o_custkey % 8 = 0 THEN 1890 WHEN o_custkey % 8 = 1 THEN 1999 WHEN o_custkey % 8 = 2 THEN NULL ELSE 1996 END AS season_year FROM {{t}}""",
        {
            "AG-001": "field_id IS NULL",
            "AG-002": NO_DAY("operation_date"),
            "AG-003": FUTURE("operation_date"),
            "AG-006": BELOW("area"),
            "AG-007": ONE_OF("lower(area_unit)", "ha", "acre", "m2", "km2"),
            "AG-008": ONE_NULL("area", "area_unit"),
            "AG-009": BELOW("yield_value"),
            "AG-011": ONE_NULL("yield_value", "yield_unit"),
            "AG-012": "yield_value IS NOT NULL AND coalesce(operation_type, '') NOT IN ('Harvest', 'harvesting')",
            "AG-014": "soil_ph < 0 OR soil_ph > 14",
            "AG-015": "soil_ph < 3.5 OR soil_ph > 9.5",
            "AG-016": "soil_om_pct < 0 OR soil_om_pct > 100",
            "AG-017": "soil_om_pct > 20",
            "AG-018": "season_year < 1900 OR season_year > 1998",
            "AG-019": f"year({DAY('operation_date')}) <> season_year",
        },
    ),
    "education": (
        "orders",
        f"""SELECT CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE CAST(o_custkey AS STRING) END AS student_unique_id, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE o_orderkey % 50 END AS school_id,
        CASE WHEN o_custkey % 8 = 0 THEN 1850 WHEN o_custkey % 8 = 1 THEN 2001 WHEN o_custkey % 8 = 2 THEN NULL ELSE 1996 END AS school_year, {ORDER_DAY} AS enrollment_date,
        CASE WHEN o_custkey % 3 = 0 THEN NULL WHEN o_custkey % 10 = 1 THEN 'soon' WHEN o_custkey % 10 = 2 THEN '1992-01-01' ELSE '1998-12-31' END AS exit_withdrawal_date, CASE WHEN o_custkey % 5 = 0 THEN 'moved' ELSE NULL END AS exit_withdrawal_type,
        CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'Maths' END AS assessment_title, CASE WHEN o_custkey % 7 = 0 THEN NULL WHEN o_custkey % 11 = 0 THEN 'absent' WHEN o_custkey % 12 = 0 THEN '-3' ELSE '71' END AS assessment_score FROM {{t}}""",
        {
            "ED-001": "student_unique_id IS NULL",
            "ED-002": "school_id IS NULL OR school_year IS NULL",
            "ED-003": "school_year < 1900 OR school_year > 1999",
            "ED-005": NO_DAY("enrollment_date"),
            "ED-006": NO_DAY("exit_withdrawal_date"),
            "ED-007": f"{DAY('exit_withdrawal_date')} < {DAY('enrollment_date')}",
            "ED-008": f"{DAY('enrollment_date')} < make_date(school_year - 1, 7, 1) OR {DAY('enrollment_date')} > make_date(school_year, 6, 30)",
            "ED-010": "exit_withdrawal_date IS NOT NULL AND exit_withdrawal_type IS NULL",
            "ED-011": ONE_NULL("assessment_title", "assessment_score"),
            "ED-012": "assessment_score = 'absent'",
            "ED-014": "assessment_score = '-3'",
        },
    ),
    "energy": (
        "lineitem",
        f"""SELECT {SHIP_DAY} AS timestamp, CASE WHEN l_partkey % 21 = 0 THEN NULL ELSE 'A' || CAST(l_suppkey AS STRING) END AS asset_id, CASE WHEN l_linenumber = 6 THEN 70000 WHEN l_linenumber = 7 THEN -1 ELSE l_partkey % 4 END AS register_address,
        CASE WHEN l_partkey % 8 = 7 THEN 9 ELSE 1 + l_partkey % 8 END AS function_code, CASE WHEN l_suppkey % 4 = 0 THEN 'n/a' WHEN l_suppkey % 4 = 1 THEN NULL ELSE CAST(l_linenumber AS STRING) END AS value,
        CASE l_orderkey % 6 WHEN 0 THEN 'GOOD' WHEN 1 THEN 'bad' WHEN 2 THEN 'stale' WHEN 3 THEN 'ok' WHEN 4 THEN NULL ELSE 'uncertain' END AS quality, CASE l_partkey % 3 WHEN 0 THEN 'Coil' WHEN 1 THEN 'discrete_input' ELSE 'holding_register' END AS object_type FROM {{t}}""",
        {
            "ENG-001": "timestamp IS NULL",
            "ENG-002": "asset_id IS NULL",
            "ENG-003": NO_DAY("timestamp"),
            "ENG-004": FUTURE("timestamp"),
            "ENG-005": "register_address < 0 OR register_address > 65535",
            "ENG-006": "function_code IN (9)",
            "ENG-007": "value = 'n/a'",
            "ENG-008": "lower(quality) NOT IN ('good', 'bad', 'uncertain', 'stale')",
            "ENG-010": "asset_id IS NOT NULL AND register_address IS NOT NULL AND timestamp IS NOT NULL AND row_number() OVER (PARTITION BY asset_id, register_address, timestamp) > 1",
            "ENG-011": "lower(object_type) <> CASE function_code WHEN 1 THEN 'coil' WHEN 2 THEN 'discrete_input' WHEN 3 THEN 'holding_register' WHEN 4 THEN 'input_register' WHEN 5 THEN 'coil' WHEN 6 THEN 'holding_register' END",
            "ENG-012": "(quality IS NULL OR quality IN ('bad', 'stale')) AND value IS NOT NULL",
        },
    ),
    "finance": (
        "lineitem",
        f"""SELECT CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_orderkey END AS transaction_id, {SHIP_DAY} AS date, CASE WHEN l_linenumber % 2 = 0 THEN l_partkey % 50 ELSE 0 END + CASE WHEN l_partkey % 29 = 0 THEN 0.125 ELSE 0 END AS debit, CASE WHEN l_linenumber % 2 = 1 THEN l_partkey % 50 WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS credit,
        CASE WHEN l_partkey % 17 = 0 THEN 'usd' WHEN l_partkey % 19 = 0 THEN NULL ELSE 'USD' END AS currency, CASE WHEN l_suppkey % 3 = 0 THEN 'a-1' ELSE 'ACC' || CAST(l_suppkey AS STRING) END AS account_code FROM {{t}}""",
        {
            "FIN-001": "transaction_id IS NULL",
            "FIN-002": "date IS NULL OR debit IS NULL OR credit IS NULL OR currency IS NULL",
            "FIN-003": NO_DAY("date"),
            "FIN-004": "debit < 0 OR credit < 0 OR abs(debit * 100 - round(debit * 100)) > 0.001",
            "FIN-005": "NOT regexp_full_match(currency, '[A-Z]{3}')",
            "FIN-006": "transaction_id IS NOT NULL AND abs(sum(debit - credit) OVER (PARTITION BY transaction_id)) > 0.01",
            "FIN-007": "debit <> 0 AND credit <> 0",
            "FIN-008": "NOT regexp_full_match(account_code, '[A-Za-z0-9]{4,12}')",
            "FIN-009": FUTURE("date"),
        },
    ),
    "finance_tick": (
        "lineitem",
        f"""SELECT {SHIP_DAY} AS timestamp, CASE WHEN l_partkey % 25 = 0 THEN NULL ELSE 'S' || CAST(l_suppkey AS STRING) END AS symbol, l_partkey % 10 - 1 AS price, CASE WHEN l_linenumber = 4 THEN 0 ELSE l_linenumber END AS size,
        l_partkey % 12 AS bid, l_suppkey % 12 AS ask, CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE 'EUR' END AS currency, CASE WHEN l_orderkey % 12 = 0 THEN NULL ELSE 'XETR' END AS exchange FROM {{t}}""",
        {
            "FIN-T-001": "timestamp IS NULL",
            "FIN-T-002": "symbol IS NULL",
            "FIN-T-003": NO_DAY("timestamp"),
            "FIN-T-004": FUTURE("timestamp"),
            "FIN-T-005": BELOW("price"),
            "FIN-T-006": BELOW("size"),
            "FIN-T-008": "bid > ask",
            "FIN-T-009": "symbol IS NOT NULL AND timestamp IS NOT NULL AND row_number() OVER (PARTITION BY symbol, timestamp, price, size) > 1",
            "FIN-T-010": "currency IS NULL OR exchange IS NULL",
        },
    ),
    "retail": (
        "part",
        """SELECT CASE p_partkey % 6 WHEN 0 THEN '96385074' WHEN 1 THEN '4006381333931' WHEN 2 THEN '4006381333930' WHEN 3 THEN '12345' WHEN 4 THEN NULL ELSE '036000291452' END AS gtin,
        CASE p_partkey % 4 WHEN 0 THEN '4006381333931' WHEN 1 THEN '96385074' WHEN 2 THEN NULL ELSE '4006381333932' END AS gln, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size END AS net_content, CASE WHEN p_size % 4 = 0 THEN NULL ELSE 'GRM' END AS net_content_uom FROM {t}""",
        {"RT-001": "gtin IS NULL", "RT-002": "gtin IN ('4006381333930', '12345')", "RT-003": "gln IN ('96385074', '4006381333932')", "RT-004": ONE_NULL("net_content", "net_content_uom")},
    ),
    "gtfs_stops": (
        "supplier",
        "SELECT CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_suppkey % 40 END AS stop_id, s_suppkey % 200 - 100 AS stop_lat, s_suppkey % 400 - 200 AS stop_lon FROM {t}",
        {"GTFS-S001": "stop_id IS NULL OR stop_lat IS NULL", "GTFS-S002": "stop_lat < -90 OR stop_lat > 90", "GTFS-S003": "stop_lon < -180 OR stop_lon > 180", "GTFS-S004": "stop_id IS NOT NULL AND count(*) OVER (PARTITION BY stop_id) > 1"},
    ),
    "gtfs_routes": (
        "customer",
        "SELECT CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_custkey - c_custkey % 3 END AS route_id, CASE WHEN c_custkey % 14 = 13 THEN NULL ELSE c_custkey % 14 END AS route_type FROM {t}",
        {"GTFS-R001": "route_id IS NULL OR route_type IS NULL", "GTFS-R002": "route_type IN (8, 9, 10)", "GTFS-R003": "route_id IS NOT NULL AND count(*) OVER (PARTITION BY route_id) > 1"},
    ),
    "gtfs_trips": (
        "orders",
        "SELECT o_custkey AS route_id, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'daily' END AS service_id, o_orderkey - o_orderkey % 2 AS trip_id FROM {t}",
        {"GTFS-T001": "service_id IS NULL", "GTFS-T002": "count(*) OVER (PARTITION BY trip_id) > 1"},
    ),
    "gtfs_stop_times": (
        "orders",
        """SELECT CASE o_orderkey % 5 WHEN 0 THEN '25:10:00' WHEN 1 THEN '8:00:00' WHEN 2 THEN '08:61:00' ELSE '08:30:00' END AS arrival_time, CASE o_orderkey % 3 WHEN 0 THEN '08:15:00' WHEN 1 THEN NULL ELSE '26:00:00' END AS departure_time,
        o_orderkey AS trip_id, o_custkey AS stop_sequence FROM {t}""",
        {"GTFS-ST002": "arrival_time = '08:61:00'", "GTFS-ST003": "departure_time = '08:15:00' AND arrival_time IN ('25:10:00', '08:30:00')", "GTFS-ST004": "false"},
    ),
    "media_content": (
        "part",
        """SELECT CASE p_partkey % 4 WHEN 0 THEN '10.5240/7791-8534-2C23-9030-8610-0' WHEN 1 THEN '10.5240/7791-8534-2C23-9030-8610-6' WHEN 2 THEN NULL ELSE '10.5240/7791' END AS eidr_id, CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 5 = 1 THEN 90000 ELSE p_size * 60 END AS runtime_seconds,
        CASE p_partkey % 3 WHEN 0 THEN 'Episode' WHEN 1 THEN 'movie' ELSE 'series' END AS content_type, CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 5 = 1 THEN 'x' ELSE '10.5240/7791-8534-2C23-9030-8610-0' END AS series_eidr_id,
        CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size % 7 END AS season_number, CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 3 = 1 THEN -1 ELSE 4 END AS episode_number FROM {t}""",
        {
            "MD-C001": "eidr_id IS NULL",
            "MD-C002": "eidr_id IN ('10.5240/7791-8534-2C23-9030-8610-6', '10.5240/7791')",
            "MD-C007": BELOW("runtime_seconds"),
            "MD-C008": "runtime_seconds > 86400",
            "MD-C009": "content_type = 'Episode' AND series_eidr_id IS NULL",
            "MD-C010": "series_eidr_id = 'x'",
            "MD-C011": "season_number <= 0 OR episode_number <= 0",
            "MD-C012": "episode_number IS NOT NULL AND season_number IS NULL",
            "MD-C013": "content_type = 'movie' AND (season_number IS NOT NULL OR episode_number IS NOT NULL)",
        },
    ),
    "media_release": (
        "part",
        """SELECT CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey END AS release_id, CASE p_partkey % 4 WHEN 0 THEN '036000291452' WHEN 1 THEN '4006-3813-33931' WHEN 2 THEN '036000291453' ELSE NULL END AS icpn, CASE p_partkey % 3 WHEN 0 THEN '1996-02-30' WHEN 1 THEN '1996-02-29' ELSE NULL END AS release_date,
        CASE p_size % 5 WHEN 0 THEN 0 WHEN 1 THEN 600 WHEN 2 THEN 2 WHEN 3 THEN 12 ELSE NULL END AS track_count, CASE WHEN p_partkey % 2 = 0 THEN 'label' ELSE NULL END AS party_role, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'P1' END AS party_id, CASE WHEN p_partkey % 2 = 0 THEN 'Single' ELSE 'album' END AS release_type FROM {t}""",
        {
            "MD-R001": "release_id IS NULL",
            "MD-R002": "icpn = '036000291453'",
            "MD-R007": "release_date = '1996-02-30'",
            "MD-R008": "track_count <= 0",
            "MD-R009": "track_count > 500",
            "MD-R010": "party_role IS NOT NULL AND party_id IS NULL",
            "MD-R011": "release_type = 'Single' AND (track_count < 1 OR track_count > 3)",
        },
    ),
    "health_patient": (
        "customer",
        """SELECT CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE c_custkey END AS patient_id, CASE c_custkey % 8 WHEN 0 THEN '1960-02-30' WHEN 1 THEN '1960' WHEN 2 THEN '1960-07' WHEN 3 THEN '1999-01-01' WHEN 4 THEN '1820-05-05' WHEN 5 THEN NULL ELSE '1971-10-03' END AS birth_date,
        CASE c_custkey % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'M' WHEN 2 THEN NULL ELSE 'unknown' END AS gender, CASE c_custkey % 6 WHEN 0 THEN '1950-01-01' WHEN 1 THEN '2001-01-01' WHEN 2 THEN '1990-01-01' ELSE NULL END AS deceased_date FROM {t}""",
        {
            "HC-P001": "patient_id IS NULL",
            "HC-P002": "birth_date IS NULL OR gender IS NULL",
            "HC-P003": "birth_date = '1960-02-30'",
            "HC-P003I": "length(birth_date) < 10",
            "HC-P004": "birth_date = '1999-01-01'",
            "HC-P005": "gender = 'M'",
            "HC-P006": "TRY_CAST(deceased_date AS DATE) < TRY_CAST(birth_date AS DATE)",
            "HC-P007": "deceased_date = '2001-01-01'",
            "HC-P009": "birth_date IN ('1820-05-05', '1999-01-01')",
        },
    ),
    "health_encounter": (
        "lineitem",
        f"""SELECT l_orderkey AS encounter_id, CASE WHEN l_partkey % 30 = 0 THEN NULL ELSE l_partkey END AS patient_id, CASE l_suppkey % 4 WHEN 0 THEN 'Finished' WHEN 1 THEN 'finished' WHEN 2 THEN 'over' ELSE 'planned' END AS status, CASE l_linenumber WHEN 1 THEN 'AMB' WHEN 2 THEN 'IMP' WHEN 3 THEN 'amb' ELSE NULL END AS class_code,
        {SHIP_DAY} AS period_start, {RECEIPT_DAY} AS period_end FROM {{t}}""",
        {
            "HC-E001": "patient_id IS NULL",
            "HC-E002": "status IN ('Finished', 'over')",
            "HC-E003": "class_code = 'amb'",
            "HC-E004": NO_DAY("period_start"),
            "HC-E005": f"{DAY('period_end')} < {DAY('period_start')}",
            "HC-E006": f"lower(status) = 'finished' AND ({FUTURE('period_start')} OR {FUTURE('period_end')})",
            "HC-E008": f"lower(status) = 'finished' AND {DAY('period_end')} - {DAY('period_start')} >= 365",
        },
    ),
    "health_observation": (
        "orders",
        f"""SELECT o_orderkey AS observation_id, o_custkey AS patient_id, CASE o_orderkey % 3 WHEN 0 THEN 'final' WHEN 1 THEN 'done' ELSE 'amended' END AS status, CASE WHEN o_custkey % 6 = 0 THEN NULL ELSE '8867-4' END AS code_value, {ORDER_DAY} AS effective_date,
        CASE o_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN -2 ELSE 7 END AS value_quantity, CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE 'high' END AS value_string, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'mmol/L' END AS value_unit, CASE o_orderkey % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'X' ELSE NULL END AS interpretation FROM {{t}}""",
        {
            "HC-O001": "code_value IS NULL",
            "HC-O002": "status = 'done'",
            "HC-O005": NO_DAY("effective_date"),
            "HC-O006": "value_quantity IS NULL AND value_string IS NULL",
            "HC-O007": "value_quantity IS NOT NULL AND value_unit IS NULL",
            "HC-O008": "value_quantity < 0",
            "HC-O009": "interpretation = 'X'",
        },
    ),
    "health_condition": (
        "orders",
        """SELECT CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey END AS condition_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS patient_id, CASE o_custkey % 4 WHEN 0 THEN 'E11.9' WHEN 1 THEN 'e11' WHEN 2 THEN NULL ELSE 'A0' END AS code_value,
        CASE o_custkey % 3 WHEN 0 THEN 'http://hl7.org/fhir/sid/ICD-10' WHEN 1 THEN 'local' ELSE NULL END AS code_system, CASE o_orderkey % 4 WHEN 0 THEN 'Active' WHEN 1 THEN 'gone' ELSE NULL END AS clinical_status, CASE o_orderkey % 3 WHEN 0 THEN '1990-05' WHEN 1 THEN 'long ago' ELSE '1990-05-17' END AS onset_date FROM {t}""",
        {
            "HC-C001": "condition_id IS NULL",
            "HC-C002": "patient_id IS NULL",
            "HC-C003": "code_value IS NULL",
            "HC-C004": "clinical_status = 'gone'",
            "HC-C005": "code_system LIKE 'http%' AND code_value IN ('e11', 'A0')",
            "HC-C006": "onset_date = 'long ago'",
        },
    ),
    "health_medication": (
        "orders",
        """SELECT o_orderkey AS medication_request_id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_custkey END AS patient_id, CASE o_orderkey % 3 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'lost' ELSE 'stopped' END AS status, CASE o_custkey % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'wish' ELSE NULL END AS intent,
        CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE '197361' END AS medication_code, CASE o_orderkey % 4 WHEN 0 THEN '1996' WHEN 1 THEN '1996-00-01' ELSE '1996-03-01' END AS authored_on FROM {t}""",
        {"HC-M001": "medication_request_id IS NULL", "HC-M002": "patient_id IS NULL", "HC-M003": "status = 'lost'", "HC-M004": "intent = 'wish'", "HC-M005": "medication_code IS NULL", "HC-M006": "authored_on = '1996-00-01'"},
    ),
}


def view(spark, sf, pack):
    at, sql, _ = PACKS[pack]
    return spark.sql(sql.replace("{{t}}", "{t}"), t=spark.read.parquet(f"{sf}/{at}.parquet"))


def duck_view(pack: str) -> str:
    at, sql, _ = PACKS[pack]
    return sql.replace("{{t}}", at).replace("{t}", at).replace("AS STRING)", "AS VARCHAR)")


def counts(pack: str):
    """The violations of each rule of a pack."""

    def run(spark, sf):
        got = domains.validate(view(spark, sf, pack), pack, as_of=AS_OF)
        return spark.createDataFrame(sorted(got["violations"].items()), "rule string, n long")

    return run


def trust(pack: str):
    def run(spark, sf):
        got = domains.validate(view(spark, sf, pack), pack, as_of=AS_OF)
        return spark.createDataFrame([(pack, got["rows"], round(got["trust"], 6))], "pack string, rows long, trust double")

    return run


def counts_sql(pack: str) -> str:
    rules = PACKS[pack][2]
    flags = ", ".join(f'({cond}) AS "{r}"' for r, cond in rules.items())
    return f"WITH d AS ({duck_view(pack)}), v AS (SELECT {flags} FROM d) " + " UNION ALL ".join(f"""SELECT '{r}' AS rule, count(*) FILTER ("{r}") AS n FROM v""" for r in rules)


def trust_sql(pack: str) -> str:
    """1 minus the mean over all rules of their weights times the shares of violating rows."""
    weight = {r.rule_id: domains.WEIGHTS[r.severity] for r in domains.PACKS[pack].rules}
    flags = ", ".join(f'({cond}) AS "{r}"' for r, cond in PACKS[pack][2].items())
    loss = " + ".join(f'{weight[r]} * count(*) FILTER ("{r}") / count(*)' for r in PACKS[pack][2])
    return f"WITH d AS ({duck_view(pack)}), v AS (SELECT {flags} FROM d) SELECT '{pack}' AS pack, count(*) AS rows, round(1 - ({loss}) / {len(weight)}, 6) AS trust FROM v"


QUERIES = {f"pack_{p}": counts(p) for p in PACKS} | {f"domain_trust_{p}": trust(p) for p in ("energy", "finance", "health_patient")}
ORACLE_SQL = {f"pack_{p}": counts_sql(p) for p in PACKS} | {f"domain_trust_{p}": trust_sql(p) for p in ("energy", "finance", "health_patient")}


def repaired_gender(spark, sf):
    out = domains.repaired(view(spark, sf, "health_patient"), "health_patient", as_of=AS_OF)
    return out.groupBy("gender").agg(F.count("*").alias("n"))


QUERIES["domain_repair_coerce"] = repaired_gender
ORACLE_SQL["domain_repair_coerce"] = f"WITH d AS ({duck_view('health_patient')}) SELECT CASE gender WHEN 'M' THEN 'male' ELSE gender END AS gender, count(*) AS n FROM d GROUP BY 1"


def repaired_reject(spark, sf):
    pack = domains.Pack("strict", (domains.Rule("X-1", "schema", "error", ("stop_id",), "not_null", repair="reject"), domains.Rule("X-2", "format", "error", ("stop_lat",), "range", {"min": -90, "max": 90}, repair="reject"), domains.Rule("X-3", "format", "info", ("name",), "not_null", repair="fill_default")), defaults={"name": "none"})
    df = view(spark, sf, "gtfs_stops").withColumn("name", F.when(F.col("stop_lon") > 0, "east"))
    return domains.repaired(df, pack).groupBy("name").agg(F.count("*").alias("n"))


QUERIES["domain_repair_reject_fill"] = repaired_reject
ORACLE_SQL["domain_repair_reject_fill"] = f"WITH d AS ({duck_view('gtfs_stops')}) SELECT CASE WHEN stop_lon > 0 THEN 'east' ELSE 'none' END AS name, count(*) AS n FROM d WHERE stop_id IS NOT NULL AND stop_lat BETWEEN -90 AND 90 GROUP BY 1"


def flagged_rules(spark, sf):
    out = domains.flagged(view(spark, sf, "retail"), "retail", as_of=AS_OF)
    return out.select("gtin", "gln", F.array_join("_violations", ",").alias("rules")).groupBy("gtin", "gln", "rules").agg(F.count("*").alias("n"))


QUERIES["domain_flagged"] = flagged_rules
_RETAIL = PACKS["retail"][2]
ORACLE_SQL["domain_flagged"] = f"WITH d AS ({duck_view('retail')}) SELECT gtin, gln, concat_ws(',', " + ", ".join(f"CASE WHEN {_RETAIL[r]} THEN '{r}' END" for r in ("RT-001", "RT-002", "RT-003", "RT-004")) + ") AS rules, count(*) AS n FROM d GROUP BY 1, 2, 3"


def feed(spark, sf):
    frames = {"orders": spark.read.parquet(f"{sf}/orders.parquet").selectExpr("o_orderkey AS trip_id", "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey END AS route_id", "'daily' AS service_id"), "routes": view(spark, sf, "gtfs_routes")}
    got = domains.validate_feed(frames, {"orders": "gtfs_trips", "routes": "gtfs_routes"}, [("orders", "route_id", "routes", "route_id")], as_of=AS_OF)
    return spark.createDataFrame([("orphans", got["orphans"]["orders", "route_id"]), ("GTFS-T001", got["frames"]["orders"]["violations"]["GTFS-T001"])], "what string, n long")


QUERIES["rule_fk_anti"] = feed
ORACLE_SQL["rule_fk_anti"] = f"WITH r AS ({duck_view('gtfs_routes')}) SELECT 'orphans' AS what, count(*) FILTER (o_custkey % 7 <> 0 AND o_custkey NOT IN (SELECT route_id FROM r WHERE route_id IS NOT NULL)) AS n FROM orders UNION ALL SELECT 'GTFS-T001', count(*) FILTER (o_custkey % 7 = 0) FROM orders"
