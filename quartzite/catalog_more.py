"""Registered queries of streaming state, drift and personal data, each with its DuckDB equivalent."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzite.operators import privacy, quality
from quartzite.plans.config import CleanOptions
from quartzite.streaming.cleaner import StreamCleaner, StreamOptions

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(name: str, oracle: str):
    def add(fn):
        QUERIES[name], ORACLE_SQL[name] = fn, oracle
        return fn

    return add


def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet")


PLAIN = CleanOptions(column_names=False, drop_duplicates=False, fix_dtypes=False, strip_whitespace=False, normalize_sentinels=False)


def streamed(spark, sf, columns, batches=4, **options):
    """The events in batches by their id, through one cleaner; the cleaned batches and the cleaner."""
    cleaner, out = StreamCleaner(PLAIN, StreamOptions(**options)), []
    sink = cleaner.as_sink(lambda df, i: out.append((df, i)))
    for i in range(batches):
        sink(events(spark, sf).where(F.col("event_id") % batches == i).selectExpr(*columns), i)
    return out, cleaner


@query("stream_welford", "SELECT count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance, min(value) AS low, max(value) AS high, count(*) - count(value) AS missing FROM events")
def stream_welford(spark, sf):
    _, cleaner = streamed(spark, sf, ["value"])
    s = cleaner.columns["value"]
    return spark.createDataFrame([(s.moments.n, round(s.moments.mean, 6), round(s.moments.std**2, 4), s.low, s.high, s.missing)], "n long, mean double, variance double, low double, high double, missing long")


@query("stream_topk", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_topk(spark, sf):
    _, cleaner = streamed(spark, sf, ["event_type"])
    return spark.createDataFrame(sorted(cleaner.columns["event_type"].top.items()), "event_type string, n long")


@query("stream_dedup_window", "WITH t AS (SELECT event_id % 4 AS b, user_id, event_type FROM events), f AS (SELECT user_id, event_type, min(b) AS first FROM t GROUP BY 1, 2) SELECT first AS batch, count(*) AS n FROM f GROUP BY 1")
def stream_dedup_window(spark, sf):
    out, _ = streamed(spark, sf, ["user_id", "event_type"], dedup=True)
    return spark.createDataFrame([(i, df.count()) for df, i in out if df.limit(1).count()], "batch long, n long")


@query(
    "stream_impute",
    """WITH t AS (SELECT event_id % 4 AS b, event_type, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS kept FROM events),
    c AS (SELECT kept, count(*) FILTER (b <= 2) AS n2, count(*) FILTER (b <= 3) AS n3 FROM t WHERE kept IS NOT NULL GROUP BY 1),
    w AS (SELECT CASE WHEN max(n2) >= 0.5 * sum(n2) THEN arg_min(kept, (-n2, kept)) ELSE 'Unknown' END AS w2, CASE WHEN max(n3) >= 0.5 * sum(n3) THEN arg_min(kept, (-n3, kept)) ELSE 'Unknown' END AS w3 FROM c)
    SELECT b AS batch, CASE WHEN kept IS NOT NULL OR b < 2 THEN kept WHEN b = 2 THEN w2 ELSE w3 END AS kept, count(*) AS n FROM t, w GROUP BY 1, 2""",
)
def stream_impute(spark, sf):
    out, _ = streamed(spark, sf, ["event_id", "CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS kept"])
    frames = [df.groupBy("kept").agg(F.count("*").alias("n")).select(F.lit(i).cast("long").alias("batch"), "kept", "n") for df, i in out]
    for f in frames[1:]:
        frames[0] = frames[0].unionByName(f)
    return frames[0]


DRIFTS = "SELECT 'missing_rate' AS check, 'user_id' AS c, CAST(2 AS BIGINT) AS batch_id UNION ALL SELECT 'distribution', 'value', 3 UNION ALL SELECT 'new_column', 'extra', 3 UNION ALL SELECT 'missing_column', 'event_type', 3"


@query("stream_drift", DRIFTS)
def stream_drift(spark, sf):
    """Batch 2 loses most users; batch 3 is shifted by ten standard deviations, has a column more and one less."""
    e = events(spark, sf)
    shift = e.agg(F.avg("value") + 10 * F.stddev("value")).first()[0]
    part = lambda i: e.where(F.col("event_id") % 4 == i)
    batches = [part(i).select("user_id", "value", "event_type") for i in range(2)]
    batches.append(part(2).select(F.when(F.col("event_id") % 8 == 2, F.col("user_id")).alias("user_id"), "value", "event_type"))
    batches.append(part(3).select(F.when(F.col("event_id") % 6 != 1, F.col("user_id")).alias("user_id"), (F.col("value") + shift).alias("value"), F.lit(1).alias("extra")))
    cleaner = StreamCleaner(PLAIN, StreamOptions())
    for i, b in enumerate(batches):
        cleaner.process(b, i)
    return spark.createDataFrame([(d["check"], d["column"], d["batch_id"]) for d in cleaner.finalize()["drift"]], "check string, c string, batch_id long")


@query("stream_replay", "SELECT CAST(3 AS BIGINT) AS batches, count(*) FILTER (event_id % 4 < 3) AS rows FROM events")
def stream_replay(spark, sf):
    """A batch whose write fails is done again and counts once; one that was written is skipped, also by a cleaner restored from its state."""
    cleaner, failed = StreamCleaner(PLAIN), []

    def write(df, i):
        if i == 1 and not failed:
            failed.append(i)
            raise OSError("disk full")

    for i in (0, 1, 1, 0, 2):
        if i == 2:
            cleaner = StreamCleaner.from_json(cleaner.state_json(), PLAIN)
        try:
            cleaner.as_sink(write)(events(spark, sf).where(F.col("event_id") % 4 == i).select("value"), i)
        except OSError:
            pass
    got = cleaner.finalize()
    return spark.createDataFrame([(got["batches"], got["rows"])], "batches long, rows long")


@query(
    "pii_counts",
    r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.-]+')) AS m FROM documents WHERE text NOT SIMILAR TO '(?s).*[^\x00-\x7F].*')
    SELECT 'EMAIL' AS entity_type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t""",
)
def pii_counts(spark, sf):
    """Mail addresses in the documents of plain ASCII, as both engines' word characters agree there."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) = octet_length(text)").select("doc_id", "text")
    got = privacy.detect(docs, "doc_id", ["text"], privacy.Detection(entities=("EMAIL",), use_context=False))
    return got.groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("id").alias("docs"))


@query("drift_schema", "SELECT * FROM (VALUES ('column_added', 'o_clerk'), ('column_removed', 'o_custkey'), ('dtype', 'o_orderstatus')) t(check_name, c)")
def drift_schema(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    base = quality.baseline(orders.select("o_orderkey", "o_custkey", "o_orderstatus"))
    changed = orders.select("o_orderkey", F.length("o_orderstatus").alias("o_orderstatus"), F.lit("x").alias("o_clerk"))
    return spark.createDataFrame([(d["check"], d["column"]) for d in quality.drift(changed, base)], "check_name string, c string")
