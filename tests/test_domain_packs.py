from quartzite.plans import domains


def bad(report):
    return {k: v for k, v in report["violations"].items() if v}


def test_transport(spark):
    times = spark.createDataFrame([("t", "08:00:00", "08:01:00", 1), ("t", "25:10:00", "25:09:00", 2), ("t", "9:99:00", None, 2)], "trip_id string, arrival_time string, departure_time string, stop_sequence int").coalesce(1)
    assert bad(domains.validate(times, "gtfs_stop_times")) == {"GTFS-ST002": 1, "GTFS-ST003": 1, "GTFS-ST004": 1}
    trips = spark.createDataFrame([("r1", "s", "a"), ("r9", "s", "b"), ("r1", "s", "b")], "route_id string, service_id string, trip_id string")
    routes = spark.createDataFrame([("r1", 3), ("r2", 99)], "route_id string, route_type int")
    got = domains.validate_feed({"trips": trips, "routes": routes}, {"trips": "gtfs_trips", "routes": "gtfs_routes"}, [("trips", "route_id", "routes", "route_id")])
    assert bad(got["frames"]["trips"]) == {"GTFS-T002": 2} and bad(got["frames"]["routes"]) == {"GTFS-R002": 1} and got["orphans"]["trips", "route_id"] == 1


def check_char(payload):
    values = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*"
    p = 0
    for c in payload:
        p = (p + values.index(c)) * 2 % 37
    return values[(38 - p) % 37]


def test_media_and_health(spark):
    good = f"10.5240/7791-8534-2C23-9030-8610-{check_char('77918534' '2C2390308610')}"
    content = spark.createDataFrame([(good, "Movie", None, 100), ("10.5240/0000-0000-0000-0000-0000-9", "Episode", None, -1)], "eidr_id string, content_type string, series_eidr_id string, runtime_seconds int")
    assert bad(domains.validate(content, "media_content")) == {"MD-C002": 1, "MD-C007": 1, "MD-C009": 1}
    release = spark.createDataFrame([("a", "4006381333931", "Single", 9), ("b", "4006381333932", "Album", 9)], "release_id string, icpn string, release_type string, track_count int")
    assert bad(domains.validate(release, "media_release")) == {"MD-R002": 1, "MD-R011": 1}
    people = spark.createDataFrame([("p", "1990-05", "Male", None), ("q", "2190-01-01", "female", "2000-01-01")], "patient_id string, birth_date string, gender string, deceased_date string")
    assert bad(domains.validate(people, "health_patient", as_of="2025-01-01")) == {"HC-P003I": 1, "HC-P004": 1, "HC-P005": 1, "HC-P006": 1, "HC-P009": 1}
    assert [r.gender for r in domains.repaired(people, "health_patient").collect()] == ["male", "female"]
