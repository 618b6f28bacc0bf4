"""Registered queries of the engine's own operators, each with its DuckDB equivalent.

The tables are clean, so most queries start from a *dirty view* that is the same SQL in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.functions import checks as K
from quartzite.functions import numbers as N
from quartzite.functions import text as X
from quartzite.operators import entity, quality, values
from quartzite.operators.dedup import deduplicate, duplicate_rows, recent_window_dedup
from quartzite.plans import cleaning, domains, inference
from quartzite.plans.config import CleanOptions
from quartzite.plans.report import Report
from quartzite.plans.stats import correlations, describe, mode_table, q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DIRTY = {
    "customer": """SELECT c_custkey AS `Cust Key`, CASE WHEN c_custkey % 11 = 0 THEN ' N/A ' WHEN c_custkey % 7 = 0 THEN '  ' || c_mktsegment || ' ' ELSE c_mktsegment END AS `MktSegment`,
        CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_acctbal END AS `acctBal`, c_nationkey AS `NationKey`, CAST(NULL AS STRING) AS `Nothing`, 'x' AS `Same` FROM {customer}""",
    "orders": """SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d,
        CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END AS priority FROM {orders}
        UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, CAST(CAST(o_orderdate AS DATE) AS STRING), CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderpriority END FROM {orders} WHERE o_orderkey % 50 = 0""",
    "events": """SELECT event_id, ts, user_id, event_type, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 997 = 1 THEN value * 100 ELSE value END AS value FROM {events}""",
    "texts": """SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'TRUE' ELSE 'f' END AS flag,
        CAST(o_custkey AS STRING) AS whole, '$' || CAST(o_custkey AS STRING) || '.5' AS money, '00' || CAST(o_custkey AS STRING) AS code,
        CASE WHEN o_orderkey % 50 = 0 THEN 'oops' ELSE CAST(o_orderkey AS STRING) END AS mostly FROM {orders}""",
    "names": """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) WHEN 1 THEN ' ' || p_name || '.' WHEN 2 THEN substring(p_name, strpos_(p_name), 99) || ' ' || substring(p_name, 1, strpos_(p_name) - 1) ELSE p_name END AS name FROM {part}""",
    "people": """SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS bal FROM {customer}
        UNION ALL SELECT 'x' || CAST(c_custkey AS STRING), substring(c_name, 1, length(c_name) - 1) || '_', c_nationkey, c_acctbal + 1 FROM {customer} WHERE c_custkey % 10 = 0""",
    "ledger": """SELECT l_orderkey AS transaction_id, CAST(l_shipdate AS DATE) AS date, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity ELSE 0.0 END AS debit, CASE WHEN l_linenumber % 2 = 1 THEN l_quantity ELSE 0.0 END AS credit,
        CASE WHEN l_partkey % 17 = 0 THEN 'usd' WHEN l_partkey % 19 = 0 THEN NULL ELSE 'USD' END AS currency, CASE WHEN l_suppkey % 3 = 0 THEN 'a-1' ELSE 'ACC' || CAST(l_suppkey AS STRING) END AS account_code, l_linenumber AS line, l_partkey AS part FROM {lineitem}""",
}
DIRTY = {k: v.replace("strpos_(p_name)", "instr(p_name, ' ')") for k, v in DIRTY.items()}
TABLES = ("customer", "orders", "events", "part", "lineitem", "documents", "supplier", "nation")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in DIRTY[name]}
    return spark.sql(DIRTY[name], **used)


def duck(name: str) -> str:
    out = DIRTY[name].replace("`", '"').replace("AS STRING)", "AS VARCHAR)")
    for t in TABLES:
        out = out.replace("{" + t + "}", t)
    return f"d AS ({out})"


def query(name: str, oracle: str | None = None, view: str | None = None):
    """Register a query; ``view`` names the dirty view that the oracle starts from, as ``d``."""

    def add(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLE_SQL[name] = f"WITH {duck(view)} {oracle}" if view and not oracle.lstrip().upper().startswith("WITH") else (oracle.replace("WITH ", f"WITH {duck(view)}, ", 1) if view else oracle)
        return fn

    return add


def frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


RAW = r"upper(\1)"
TRIMMED = "trim(\"MktSegment\")"
REPAIRED = f"CASE WHEN lower({TRIMMED}) IN ('', 'n/a', 'na', 'null', 'none', '-') THEN NULL ELSE {TRIMMED} END"

# --- repair -----------------------------------------------------------------------------------------------------------------


@query("rename_trim_sentinel", f'SELECT "Cust Key" AS cust_key, {REPAIRED} AS mkt_segment, "acctBal" AS acct_bal, "NationKey" AS nation_key, \'x\' AS same FROM d', "customer")
def rename_trim_sentinel(spark, sf):
    return cleaning.repair(dirty(spark, sf, "customer"), CleanOptions(fix_dtypes=False, drop_duplicates=False), Report())


FLAGSHIP = rename_trim_sentinel


@query("string_repair_counts", f'SELECT CAST(count(*) FILTER ({TRIMMED} <> "MktSegment") AS BIGINT) AS stripped, CAST(count(*) FILTER ("MktSegment" IS NOT NULL AND {REPAIRED} IS NULL) AS BIGINT) AS sentinels FROM d', "customer")
def string_repair_counts(spark, sf):
    r = Report()
    cleaning.repair(dirty(spark, sf, "customer"), CleanOptions(fix_dtypes=False, drop_duplicates=False), r)
    got = {a.step: a.count for a in r.actions if a.column == "mkt_segment"}
    return frame(spark, [(got.get("strip_whitespace", 0), got.get("normalize_sentinels", 0))], "stripped long, sentinels long")


@query("drop_empty_columns", 'SELECT "Cust Key" AS "Cust Key", "acctBal" AS "acctBal" FROM d', "customer")
def drop_empty_columns(spark, sf):
    return cleaning.repair(dirty(spark, sf, "customer").select("Cust Key", "acctBal", "Nothing"), CleanOptions(column_names=False, fix_dtypes=False, drop_duplicates=False), Report())


@query("drop_empty_rows", 'SELECT "acctBal" AS "acctBal", "MktSegment" AS "MktSegment" FROM (SELECT "acctBal", CASE WHEN "Cust Key" % 26 = 0 THEN NULL ELSE "MktSegment" END AS "MktSegment" FROM d) t WHERE "acctBal" IS NOT NULL OR "MktSegment" IS NOT NULL', "customer")
def drop_empty_rows(spark, sf):
    df = dirty(spark, sf, "customer").selectExpr("acctBal", "CASE WHEN `Cust Key` % 26 = 0 THEN NULL ELSE MktSegment END AS MktSegment")
    return cleaning.repair(df, CleanOptions(column_names=False, fix_dtypes=False, drop_duplicates=False, strip_whitespace=False, normalize_sentinels=False), Report())


@query("drop_constant_columns", 'SELECT "Cust Key" AS cust_key, "NationKey" AS nation_key FROM d', "customer")
def drop_constant_columns(spark, sf):
    return cleaning.repair(dirty(spark, sf, "customer").select("Cust Key", "NationKey", "Same", "Nothing"), CleanOptions(fix_dtypes=False, drop_duplicates=False, drop_constant_columns=True), Report())


@query("downcast_integers", "SELECT 'l_linenumber' AS c, 'tinyint' AS t, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem UNION ALL SELECT 'wide', 'bigint', count(*), CAST(sum(l_orderkey * 10000000000) AS BIGINT) FROM lineitem")
def downcast_integers(spark, sf):
    df = table(spark, sf, "lineitem").select("l_linenumber", (F.col("l_orderkey") * 10_000_000_000).alias("wide"))
    out = cleaning.optimize_memory(df, CleanOptions(), Report())
    return totals(out)


def totals(df: DataFrame) -> DataFrame:
    """c, t, n, total: a row for each integer column. The sums are exact; where one is beyond 64 bits, the column of totals is a decimal."""
    got = df.agg(F.count("*").alias("n"), *(F.sum(q(c).cast("decimal(38,0)")).alias(f"s{i}") for i, c in enumerate(df.columns))).first()
    sums = [got[f"s{i}"] for i in range(len(df.columns))]
    wide = any(x is not None and not -(2**63) <= x < 2**63 for x in sums)
    rows = [(c, t, got.n, x if x is None or wide else int(x)) for (c, t), x in zip(df.dtypes, sums, strict=True)]
    return frame(df.sparkSession, rows, f"c string, t string, n long, total {'decimal(38,0)' if wide else 'long'}")


# --- duplicates -------------------------------------------------------------------------------------------------------------


@query("dedup_full", "SELECT DISTINCT * FROM d", "orders")
def dedup_full(spark, sf):
    return deduplicate(dirty(spark, sf, "orders"))


LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINE.split(", ")).withColumn("o", F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))


def _subset(keep: str, direction: str):
    sql = f"SELECT {LINE} FROM (SELECT {LINE}, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey {direction}, l_suppkey {direction}, l_quantity {direction}, l_extendedprice {direction}) AS rn FROM lineitem) t WHERE rn = 1"

    @query(f"dedup_subset_{keep}", sql)
    def run(spark, sf):
        return deduplicate(_lines(spark, sf), ["l_orderkey", "l_linenumber"], keep, "o").drop("o")


_subset("first", "ASC")
_subset("last", "DESC")


@query("dedup_drop_all", f"SELECT {LINE} FROM (SELECT {LINE}, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) t WHERE n = 1")
def dedup_drop_all(spark, sf):
    return deduplicate(_lines(spark, sf), ["l_orderkey", "l_linenumber"], "drop", "o").drop("o")


@query("dedup_aggregate", "SELECT o_custkey, round(avg(o_orderkey), 4) AS o_orderkey, round(avg(price), 4) AS price FROM d GROUP BY o_custkey", "orders")
def dedup_aggregate(spark, sf):
    out = deduplicate(dirty(spark, sf, "orders").select("o_custkey", "o_orderkey", "price"), ["o_custkey"], "aggregate")
    return out.select("o_custkey", F.round("o_orderkey", 4).alias("o_orderkey"), F.round("price", 4).alias("price"))


@query("dedup_report", "SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM d) u) AS BIGINT) AS duplicates FROM d", "orders")
def dedup_report(spark, sf):
    return frame(spark, [(duplicate_rows(dirty(spark, sf, "orders")),)], "duplicates long")


@query("dedup_recent_window", "SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id % 2 = 0)")
def dedup_recent_window(spark, sf):
    e = table(spark, sf, "events")
    seen = e.where("event_id % 2 = 0").select(F.xxhash64("user_id", "event_type").alias("h")).distinct()
    return recent_window_dedup(e.where("event_id % 2 = 1").select("user_id", "event_type"), seen)


# --- types --------------------------------------------------------------------------------------------------------------


def _typed(name: str, column: str, oracle: str):
    @query(name, oracle, "texts")
    def run(spark, sf):
        df = dirty(spark, sf, "texts").select("k", column)
        return inference.apply(df, inference.suggest(df, CleanOptions()))


_typed("infer_boolean", "flag", "SELECT k, lower(flag) IN ('true', 't', 'yes', 'y') AS flag FROM d")
_typed("infer_numeric_plain", "whole", "SELECT k, CAST(whole AS BIGINT) AS whole FROM d")
_typed("infer_numeric_currency", "money", "SELECT k, CAST(replace(money, '$', '') AS DOUBLE) AS money FROM d")
_typed("leading_zero_guard", "code", "SELECT k, code FROM d")


@query("infer_numeric_coerced", "SELECT k, CAST(TRY_CAST(mostly AS BIGINT) AS DOUBLE) AS mostly FROM d", "texts")
def infer_numeric_coerced(spark, sf):
    df = dirty(spark, sf, "texts").select("k", "mostly")
    out = inference.apply(df, inference.suggest(df, CleanOptions()))
    return out.select("k", F.col("mostly").cast("double").alias("mostly")) if dict(out.dtypes)["mostly"] == "bigint" else out




@query("infer_numeric_locale", "SELECT o_orderkey AS k, CAST(o_custkey + 0.5 AS DOUBLE) AS v FROM orders")
def infer_numeric_locale(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey AS k", "concat(o_custkey, ',5') AS v")
    o = CleanOptions(decimal=",", thousands=".")
    return inference.apply(df, inference.suggest(df, o))


@query("infer_datetime_dayfirst", "SELECT o_orderkey AS k, date_trunc('day', o_orderdate) AS v FROM orders")
def infer_datetime_dayfirst(spark, sf):
    df = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "d/M/yyyy").alias("v"))
    return inference.apply(df, inference.suggest(df, CleanOptions()))


@query("type_candidate_counts", "SELECT count(money) AS n, count(TRY_CAST(money AS DOUBLE)) AS plain, count(TRY_CAST(replace(money, '$', '') AS DOUBLE)) AS formatted FROM d", "texts")
def type_candidate_counts(spark, sf):
    c = inference.candidates(F.col("money"), CleanOptions())
    return dirty(spark, sf, "texts").agg(*(c[k].alias(k) for k in ("n", "plain", "formatted")))


# --- profile ------------------------------------------------------------------------------------------------------------------

STATS_SQL = "count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, round(skewness(value), 5) AS skew"


@query("profile_numeric", f"SELECT {STATS_SQL} FROM d", "events")
def profile_numeric(spark, sf):
    s = describe(dirty(spark, sf, "events"), ["value"], modes=False)["value"]
    return frame(spark, [(s.n, *(round(x, 6) for x in (s.mean, s.std, s.q1, s.median, s.q3)), round(s.skew, 5))], "n long, mean double, std double, q1 double, median double, q3 double, skew double")


@query(
    "profile_columns",
    """SELECT 'o_orderkey' AS "column", count(*) AS rows, count(*) - count(o_orderkey) AS missing, count(DISTINCT o_orderkey) AS "distinct" FROM d
    UNION ALL SELECT 'price', count(*), count(*) - count(price), count(DISTINCT price) FROM d UNION ALL SELECT 'priority', count(*), count(*) - count(priority), count(DISTINCT priority) FROM d""",
    "orders",
)
def profile_columns(spark, sf):
    return quality.profile(dirty(spark, sf, "orders").select("o_orderkey", "price", "priority")).select("column", "rows", "missing", "distinct")


@query("infer_roles", "SELECT * FROM (VALUES ('o_orderkey', 'id'), ('o_custkey', 'numeric'), ('o_totalprice', 'numeric'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'categorical')) t(\"column\", role)")
def infer_roles(spark, sf):
    return quality.profile(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")).select("column", "role")


@query("mode_ratio", "WITH c AS (SELECT priority, count(*) AS n FROM d WHERE priority IS NOT NULL GROUP BY 1) SELECT priority AS mode, n AS mode_count, round(n / (SELECT sum(n) FROM c), 6) AS ratio FROM c ORDER BY n DESC, priority LIMIT 1", "orders")
def mode_ratio(spark, sf):
    s = describe(dirty(spark, sf, "orders"), ["priority"])["priority"]
    return frame(spark, [(s.mode, s.mode_count, round(s.mode_ratio, 6))], "mode string, mode_count long, ratio double")


@query("mode_values", "SELECT * FROM (SELECT 'o_orderstatus' AS \"column\", o_orderstatus AS mode, count(*) AS n FROM orders GROUP BY 2 ORDER BY n DESC, 2 LIMIT 1) a UNION ALL SELECT * FROM (SELECT 'o_orderpriority', o_orderpriority, count(*) AS n FROM orders GROUP BY 2 ORDER BY n DESC, 2 LIMIT 1) b")
def mode_values(spark, sf):
    df = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    return frame(spark, [(c, v, n) for c, (v, n, _) in mode_table(df, list(df.schema)).items()], "column string, mode string, n long")


@query("skewness_sample", "SELECT round(skewness(l_extendedprice), 6) AS skew FROM lineitem")
def skewness_sample(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(N.sample_skewness(F.col("l_extendedprice")), 6).alias("skew"))


@query("corr_matrix", "SELECT round(abs(corr(l_quantity, l_extendedprice)), 6) AS qp, round(abs(corr(l_quantity, l_discount)), 6) AS qd, round(abs(corr(l_extendedprice, l_discount)), 6) AS pd FROM lineitem")
def corr_matrix(spark, sf):
    c = correlations(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])
    return frame(spark, [(round(c["l_extendedprice", "l_quantity"], 6), round(c["l_discount", "l_quantity"], 6), round(c["l_discount", "l_extendedprice"], 6))], "qp double, qd double, pd double")


@query(
    "informative_missing",
    """SELECT abs(avg(l_quantity) FILTER (v IS NULL) - avg(l_quantity) FILTER (v IS NOT NULL)) / sqrt(((count(*) FILTER (v IS NULL) - 1) * var_samp(l_quantity) FILTER (v IS NULL) + (count(*) FILTER (v IS NOT NULL) - 1) * var_samp(l_quantity) FILTER (v IS NOT NULL)) / (count(*) - 2)) >= 0.5 AS informative
    FROM (SELECT l_quantity, CASE WHEN l_quantity > 40 THEN NULL ELSE l_tax END AS v FROM lineitem) t""",
)
def informative_missing(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_quantity", "CASE WHEN l_quantity > 40 THEN NULL ELSE l_tax END AS v")
    return frame(spark, [("v" in cleaning.informative(df, describe(df, modes=False)),)], "informative boolean")


@query("time_order_check", "SELECT * FROM (VALUES ('ts', true), ('user_id', false)) t(\"column\", ordered)")
def time_order_check(spark, sf):
    got = cleaning.time_order(table(spark, sf, "events"), ["ts", "user_id"], "event_id")
    return frame(spark, list(got.items()), "column string, ordered boolean")


# --- missing values -------------------------------------------------------------------------------------------------------


def _imputed(name: str, strategy: str, oracle: str, columns: list[str]):
    @query(name, oracle, "orders")
    def run(spark, sf):
        out = cleaning.impute(dirty(spark, sf, "orders").select("o_orderkey", *columns), strategy, columns)
        return out.select("o_orderkey", *(F.round(c, 4).alias(c) if dict(out.dtypes)[c] == "double" else F.col(c) for c in columns))


_imputed("impute_mean", "mean", "SELECT o_orderkey, round(coalesce(price, (SELECT avg(price) FROM d)), 4) AS price FROM d", ["price"])
_imputed("impute_median", "median", "SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d)), 4) AS price FROM d", ["price"])
MODE_SQL = "(SELECT priority FROM d WHERE priority IS NOT NULL GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1)"
_imputed("impute_mode", "mode", f"SELECT o_orderkey, coalesce(priority, {MODE_SQL}) AS priority FROM d", ["priority"])
_imputed("impute_auto", "auto", f"SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM d)), 4) AS price, coalesce(priority, {MODE_SQL}) AS priority FROM d", ["price", "priority"])


@query("fill_ordered", "SELECT event_id, coalesce(last_value(t IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(t IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS t FROM (SELECT event_id, CASE WHEN event_id % 40 = 0 THEN NULL ELSE ts END AS t FROM events) x")
def fill_ordered(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 40 = 0 THEN NULL ELSE ts END AS t")
    o = CleanOptions(order_by="event_id")
    _, _, choices, _ = cleaning.decide_missing(df, o)
    return cleaning.fill(df, choices, set(), o)


@query("missing_indicator", "SELECT o_orderkey, price IS NULL AS price_was_missing FROM d", "orders")
def missing_indicator(spark, sf):
    df = dirty(spark, sf, "orders").select("o_orderkey", "price")
    return cleaning.fill(df, [], {"price"}, CleanOptions()).select("o_orderkey", "price_was_missing")


@query("engine_missing_balanced", "SELECT event_id, round(coalesce(value, (SELECT quantile_cont(value, 0.5) FROM d)), 4) AS value FROM d", "events")
def engine_missing_balanced(spark, sf):
    df = dirty(spark, sf, "events").select("event_id", "value")
    _, _, choices, _ = cleaning.decide_missing(df, CleanOptions())
    return cleaning.fill(df, choices, set(), CleanOptions()).select("event_id", F.round("value", 4).alias("value"))


@query("engine_missing_aggressive", "SELECT event_id FROM events")
def engine_missing_aggressive(spark, sf):
    df = table(spark, sf, "events").selectExpr("event_id", "CASE WHEN event_id % 10 = 0 THEN event_type END AS rare")
    o = CleanOptions(strategy="aggressive")
    _, _, choices, _ = cleaning.decide_missing(df, o)
    return cleaning.fill(df, choices, set(), o)


# --- outliers -------------------------------------------------------------------------------------------------------------

IQR = "f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM d), g AS (SELECT a - 1.5 * (b - a) AS lo, b + 1.5 * (b - a) AS hi FROM f)"
ZSC = "g AS (SELECT avg(value) - 3 * stddev_samp(value) AS lo, avg(value) + 3 * stddev_samp(value) AS hi FROM d)"
FLAG, CLIP = "SELECT event_id, coalesce(value < lo OR value > hi, false) AS value_outlier FROM d, g", "SELECT event_id, round(CASE WHEN value IS NULL THEN NULL ELSE least(greatest(value, lo), hi) END, 5) AS value FROM d, g"


def _outliers(name: str, action: str, method: str, oracle: str):
    @query(name, oracle, "events")
    def run(spark, sf):
        out = cleaning.handle_outliers(dirty(spark, sf, "events").select("event_id", "value"), action, method, columns=["value"])
        return out.select("event_id", "value_outlier") if action == "flag" else out.select("event_id", F.round("value", 5).alias("value"))


_outliers("outlier_iqr_flag", "flag", "iqr", f"WITH {IQR} {FLAG}")
_outliers("outlier_iqr_clip", "clip", "iqr", f"WITH {IQR} {CLIP}")
_outliers("outlier_zscore_flag", "flag", "zscore", f"WITH {ZSC} {FLAG}")
_outliers("outlier_zscore_clip", "clip", "zscore", f"WITH {ZSC} {CLIP}")


@query(
    "outlier_auto_method",
    "WITH f AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM d) SELECT CASE WHEN abs(skewness(value)) < 0.5 THEN 'zscore' ELSE 'iqr' END AS method FROM d, f WHERE value BETWEEN a - 3 * (b - a) AND b + 3 * (b - a)",
    "events",
)
def outlier_auto_method(spark, sf):
    df = dirty(spark, sf, "events").select("value")
    return frame(spark, [(cleaning.fences(df, describe(df, modes=False), "auto", None)["value"][2],)], "method string")


@query("outlier_remove", f"WITH {IQR} SELECT event_id FROM d, g WHERE NOT coalesce(value < lo OR value > hi, false)", "events")
def outlier_remove(spark, sf):
    df = dirty(spark, sf, "events").select("event_id", "value")
    return cleaning.engine_outliers(df, {"event_id": "id", "value": "numeric"}, CleanOptions(outlier_action="remove"), Report()).select("event_id")


@query("engine_outliers", f"WITH {IQR} SELECT event_id, coalesce(value < lo OR value > hi, false) AS value_outlier FROM d, g", "events")
def engine_outliers(spark, sf):
    df = dirty(spark, sf, "events").select("event_id", "value")
    return cleaning.engine_outliers(df, {"event_id": "id", "value": "numeric"}, CleanOptions(), Report()).select("event_id", "value_outlier")


# --- the clean and its reports ------------------------------------------------------------------------------------------


@query("clean_default", "WITH u AS (SELECT DISTINCT o_orderkey, price FROM d) SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM u)), 4) AS price FROM u", "orders")
def clean_default(spark, sf):
    out, _ = cleaning.clean(dirty(spark, sf, "orders").select("o_orderkey", "price"))
    return out.select("o_orderkey", F.round("price", 4).alias("price"))


@query("clean_lineitem", "SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def clean_lineitem(spark, sf):
    return cleaning.clean(table(spark, sf, "lineitem"), strategy="conservative")[0]


@query("audit_log", "SELECT 'column_names' AS step, CAST(6 AS BIGINT) AS n UNION ALL SELECT 'strip_whitespace', count(*) FILTER (trim(\"MktSegment\") <> \"MktSegment\") FROM d UNION ALL SELECT 'normalize_sentinels', count(*) FILTER (lower(trim(\"MktSegment\")) = 'n/a') FROM d UNION ALL SELECT 'drop_empty_columns', 1", "customer")
def audit_log(spark, sf):
    _, r = cleaning.clean(dirty(spark, sf, "customer"), strategy="conservative", fix_dtypes=False)
    return r.to_frame(spark).groupBy("step").agg(F.sum("count").alias("n"))


@query("suggest_plan", "SELECT * FROM (VALUES ('price', 'median'), ('priority', 'constant')) t(\"column\", action)")
def suggest_plan(spark, sf):
    plan = cleaning.suggest_plan(dirty(spark, sf, "orders").select("o_orderkey", "price", "priority"))
    return frame(spark, [(c.column, c.action) for c in plan if c.step == "missing"], "column string, action string")


@query("compare_clean", "WITH u AS (SELECT DISTINCT o_orderkey, price FROM d) SELECT 'conservative' AS strategy, count(*) AS rows, count(*) - count(price) AS missing_left FROM u UNION ALL SELECT 'balanced', count(*), 0 FROM u UNION ALL SELECT 'aggressive', count(*), 0 FROM u", "orders")
def compare_clean(spark, sf):
    rows = cleaning.compare(dirty(spark, sf, "orders").select("o_orderkey", "price"))
    return frame(spark, [(r["strategy"], r["rows"], r["missing_left"]) for r in rows], "strategy string, rows long, missing_left long")


@query("findings", "SELECT 'info' AS severity, CAST(2 AS BIGINT) AS n UNION ALL SELECT 'warning', 1")
def findings(spark, sf):
    from quartzite.plans.report import finding

    rows = [finding("a", "c", "low", 1, "x"), finding("b", "c", "notice", 1, "y"), finding("c", "d", "WARN", 2, "z")]
    return frame(spark, [(r["severity"], 1) for r in rows], "severity string, k int").groupBy("severity").agg(F.count("*").alias("n"))


# --- trust ----------------------------------------------------------------------------------------------------------------


TRUST_SQL = """WITH q AS (SELECT quantile_cont(o_orderkey, 0.25) AS a, quantile_cont(o_orderkey, 0.75) AS b, quantile_cont(price, 0.25) AS pa, quantile_cont(price, 0.75) AS pb FROM d),
m AS (SELECT count(*) AS n, count(price) AS np, count(priority) AS nr, count(*) FILTER (price < pa - 1.5 * (pb - pa) OR price > pb + 1.5 * (pb - pa)) AS bad FROM d, q),
u AS (SELECT count(*) AS k FROM (SELECT DISTINCT o_orderkey, price, priority FROM d) t)
SELECT round((n + np + nr) / (3 * n), 6) AS completeness, round(1 - bad / (n + np + nr), 6) AS validity, round(k / n, 6) AS uniqueness FROM m, u"""


@query("trust_score", TRUST_SQL, "orders")
def trust_score(spark, sf):
    t = quality.trust_score(dirty(spark, sf, "orders").select("o_orderkey", "price", "priority"))
    return frame(spark, [tuple(round(t[k], 6) for k in ("completeness", "validity", "uniqueness"))], "completeness double, validity double, uniqueness double")


@query("trust_gate", "SELECT true AS passed, 'A' AS grade")
def trust_gate(spark, sf):
    t = quality.trust_gate(table(spark, sf, "orders"))
    return frame(spark, [(t["passed"], t["grade"])], "passed boolean, grade string")


# --- clusters, masks, validation ----------------------------------------------------------------------------------------

FP = "list_aggregate(list_sort(list_distinct(list_filter(string_split_regex(regexp_replace(lower(trim(name)), '[^a-z0-9_ ]', '', 'g'), ' +'), lambda x: x <> ''))), 'string_agg', ' ')"
PICK = f"k AS (SELECT name, {FP} AS cluster_key, count(*) AS n FROM d GROUP BY name), c AS (SELECT cluster_key, name AS value, n AS count, first_value(name) OVER (PARTITION BY cluster_key ORDER BY n DESC, length(name) DESC, name) AS canonical, count(*) OVER (PARTITION BY cluster_key) AS v FROM k)"


@query("cluster_fingerprint", f"WITH {PICK} SELECT cluster_key, value, count, canonical FROM c WHERE v >= 2", "names")
def cluster_fingerprint(spark, sf):
    return values.clusters(dirty(spark, sf, "names"), "name")


@query("cluster_ngram", "SELECT p_partkey, list_aggregate(list_sort(list_distinct(list_transform(range(1, length(s)), lambda i: substring(s, i, 2)))), 'string_agg', '') AS key FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS s FROM part) t")
def cluster_ngram(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.ngram_key(F.col("p_name")).alias("key"))


@query("merge_clusters", f"WITH {PICK} SELECT p_partkey, coalesce(canonical, name) AS name FROM d LEFT JOIN (SELECT * FROM c WHERE v >= 2) c ON d.name = c.value", "names")
def merge_clusters(spark, sf):
    return values.merge_clusters(dirty(spark, sf, "names"), ["name"], ("fingerprint",))


def _hmac_sql(text: str, key: bytes) -> str:
    k = key.ljust(64, b"\0")
    pad = lambda x: bytes(b ^ x for b in k).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode({text}))))"


@query("mask_hash_hmac", f"SELECT c_custkey, {_hmac_sql('c_name', b'pepper')} AS c_name FROM customer")
def mask_hash_hmac(spark, sf):
    return values.mask(table(spark, sf, "customer").select("c_custkey", "c_name"), [values.MaskRule("hash", ("c_name",), salt="pepper")])


@query("mask_partial", "SELECT c_custkey, '***' || right(c_name, 4) AS c_name FROM customer")
def mask_partial(spark, sf):
    return values.mask(table(spark, sf, "customer").select("c_custkey", "c_name"), [values.MaskRule("partial", ("c_name",), placeholder="***")])


@query("mask_redact", "SELECT c_custkey, '[REDACTED]' AS c_name FROM customer")
def mask_redact(spark, sf):
    return values.mask(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), [values.MaskRule("redact", pattern="name$"), values.MaskRule("drop", ("c_acctbal",))])


@query("mask_regex_scrub", "SELECT c_custkey, regexp_replace(c_name, '[0-9]', '#', 'g') AS c_name FROM customer")
def mask_regex_scrub(spark, sf):
    return values.mask(table(spark, sf, "customer").select("c_custkey", "c_name"), [values.MaskRule("regex_scrub", ("c_name",), placeholder="#")])


@query("tokenize_detokenize", "SELECT c_custkey, c_name FROM customer")
def tokenize_detokenize(spark, sf):
    df, rule = table(spark, sf, "customer").select("c_custkey", "c_name"), values.MaskRule("tokenize", ("c_name",), salt="k")
    return values.detokenize(values.mask(df, [rule]), "c_name", values.vault(df, "c_name", rule))


@query("surrogate")
def surrogate(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", values.surrogate(F.col("c_name"), b"k", 2).alias("c_name"))


@query("validate_reference", "SELECT 'c_mktsegment' AS \"column\", count(*) AS n_values, count(*) FILTER (lower(c_mktsegment) NOT IN ('machinery', 'household')) AS n_invalid, round(count(*) FILTER (lower(c_mktsegment) NOT IN ('machinery', 'household')) / count(*), 6) AS invalid_ratio FROM customer")
def validate_reference(spark, sf):
    out = values.validate(table(spark, sf, "customer"), {"c_mktsegment": lambda c: values.in_reference(c, ["Machinery", "Household"])})
    return out.select("column", "n_values", "n_invalid", F.round("invalid_ratio", 6).alias("invalid_ratio"))


@query("validate_regex", "SELECT 'p_brand' AS \"column\", count(*) AS n_values, count(*) FILTER (NOT regexp_full_match(p_brand, 'Brand#[0-9]')) AS n_invalid FROM part")
def validate_regex(spark, sf):
    return values.validate(table(spark, sf, "part"), {"p_brand": lambda c: values.matches(c, "Brand#[0-9]")}).select("column", "n_values", "n_invalid")


@query("k_anonymity", "WITH g AS (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment) SELECT min(n) AS smallest, count(*) FILTER (n < 12) AS risky_groups, CAST(coalesce(sum(n) FILTER (n < 12), 0) AS BIGINT) AS risky_rows FROM g")
def k_anonymity(spark, sf):
    g = values.k_anonymity(table(spark, sf, "customer"), ["c_nationkey", "c_mktsegment"], 12)
    return frame(spark, [(g["smallest"], g["risky_groups"], g["risky_rows"])], "smallest long, risky_groups long, risky_rows long")


# --- drift ------------------------------------------------------------------------------------------------------------------


@query("baseline_numeric", "SELECT round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS std, round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99 FROM lineitem")
def baseline_numeric(spark, sf):
    e = quality.baseline(table(spark, sf, "lineitem").select("l_extendedprice"))["columns"]["l_extendedprice"]
    return frame(spark, [tuple(round(x, 4) for x in (e["mean"], e["std"], e["quantiles"][0], e["quantiles"][-1]))], "mean double, std double, p01 double, p99 double")


@query("baseline_topk", "SELECT 'h:' || substring(sha1(o_orderpriority), 1, 16) AS label, count(*) AS n FROM orders GROUP BY 1")
def baseline_topk(spark, sf):
    e = quality.baseline(table(spark, sf, "orders").select("o_orderpriority"))["columns"]["o_orderpriority"]
    return frame(spark, list(e["top"].items()), "label string, n long")


@query("drift_psi_categorical", "WITH b AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders) AS e FROM orders GROUP BY 1), c AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) AS a FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT round(sum((a - e) * ln(a / e)), 6) AS psi FROM b JOIN c USING (v)")
def drift_psi_categorical(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    e = quality.baseline(o.select("o_orderpriority"))["columns"]["o_orderpriority"]
    return frame(spark, [(round(quality.psi_categorical(o.where("o_orderkey % 3 = 0"), "o_orderpriority", e), 6),)], "psi double")


@query("drift_none", "SELECT CAST(0 AS BIGINT) AS findings")
def drift_none(spark, sf):
    o = table(spark, sf, "orders")
    return frame(spark, [(len(quality.drift(o, quality.baseline(o))),)], "findings long")


@query("drift_ks")
def drift_ks(spark, sf):
    li = table(spark, sf, "lineitem")
    e = quality.baseline(li.select("l_quantity"))["columns"]["l_quantity"]
    moved = li.select((F.col("l_quantity") + 20).alias("l_quantity"))
    return frame(spark, [(quality.ks_statistic(moved, "l_quantity", e), quality.psi_numeric(moved, "l_quantity", e))], "ks double, psi double")


@query("contract_checks", "SELECT * FROM (SELECT 'minimum' AS \"check\", 'l_quantity' AS \"column\", count(*) FILTER (l_quantity < 5) AS count FROM lineitem UNION ALL SELECT 'allowed', 'l_returnflag', count(*) FILTER (l_returnflag NOT IN ('A', 'N')) FROM lineitem) t WHERE count > 0")
def contract_checks(spark, sf):
    got = quality.check_contract(table(spark, sf, "lineitem"), {"l_quantity": quality.ColumnContract("float", minimum=5), "l_returnflag": quality.ColumnContract(allowed=("A", "N"))})
    return frame(spark, [(g["check"], g["column"], g["count"]) for g in got], "check string, column string, count long")


# --- entity resolution ----------------------------------------------------------------------------------------------------

ER = entity.Resolution("id", [["nation", "substring(name, 1, 17)"]], [entity.Comparison("name", "levenshtein", 2.0), entity.Comparison("bal", "numeric_distance", 1.0, 100.0)], 0.9, 0.7)
PAIRS = "p AS (SELECT a.id AS left_id, b.id AS right_id, a.name AS an, b.name AS bn, a.bal AS ab, b.bal AS bb FROM d a JOIN d b ON a.nation = b.nation AND substring(a.name, 1, 17) = substring(b.name, 1, 17) AND a.id < b.id)"
SCORED = "s AS (SELECT left_id, right_id, (2 * (1 - levenshtein(an, bn) / greatest(length(an), length(bn))) + greatest(0, 1 - abs(ab - bb) / 100)) / 3 AS score FROM p)"


@query("er_candidates", f"WITH {PAIRS} SELECT left_id, right_id FROM p", "people")
def er_candidates(spark, sf):
    return entity.candidates(dirty(spark, sf, "people"), ER)


@query("er_scores", f"WITH {PAIRS}, {SCORED} SELECT left_id, right_id, round(score, 6) AS score, CASE WHEN score >= 0.9 THEN 'match' WHEN score >= 0.7 THEN 'possible' ELSE 'non_match' END AS decision FROM s", "people")
def er_scores(spark, sf):
    df = dirty(spark, sf, "people")
    return entity.scores(df, entity.candidates(df, ER), ER).select("left_id", "right_id", F.round("score", 6).alias("score"), "decision")


@query(
    "er_clusters",
    f"WITH RECURSIVE {{d}}, {PAIRS}, {SCORED}, e AS (SELECT left_id AS a, right_id AS b FROM s WHERE score >= 0.9 UNION SELECT right_id, left_id FROM s WHERE score >= 0.9), r AS (SELECT id AS a, id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), m AS (SELECT a AS id, min(b) AS root FROM r GROUP BY a) SELECT id, 'er_' || lpad(CAST(dense_rank() OVER (ORDER BY root) AS VARCHAR), 6, '0') AS cluster_id FROM m",
)
def er_clusters(spark, sf):
    return entity.resolve(dirty(spark, sf, "people"), ER).select("id", "cluster_id")


ORACLE_SQL["er_clusters"] = ORACLE_SQL["er_clusters"].replace("{d}", duck("people"))


@query("link_records")
def link_records(spark, sf):
    c = table(spark, sf, "customer").selectExpr("CAST(c_custkey AS STRING) AS id", "c_name AS name", "c_nationkey AS nation", "c_acctbal AS bal")
    moved = c.where("nation < 5").selectExpr("concat('r', id) AS id", "name", "nation", "bal")
    import dataclasses

    return entity.link(c, moved, dataclasses.replace(ER, link_only=True)).select("id", "_source", "cluster_id", "is_canonical")


@query("sim_levenshtein", "SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)), 6) AS s FROM part")
def sim_levenshtein(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.round(X.levenshtein_similarity(F.col("p_name"), F.col("p_type")), 6).alias("s"))


SOUNDEX_SQL = """WITH s AS (SELECT p_partkey, upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')) AS w FROM part),
c AS (SELECT p_partkey, w, translate(w, 'BFPVCGJKQSXZDTLMNRAEIOUYHW', '11112222222233455600000077') AS k FROM s),
r AS (SELECT p_partkey, w, left(k, 1) || replace(substring(k, 2), '7', '') AS k FROM c),
u AS (SELECT p_partkey, w, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(k, '1+', '1', 'g'), '2+', '2', 'g'), '3+', '3', 'g'), '4+', '4', 'g'), '5+', '5', 'g'), '6+', '6', 'g') AS k FROM r)
SELECT p_partkey, CASE WHEN w = '' THEN '0000' ELSE left(w, 1) || rpad(left(replace(substring(k, 2), '0', ''), 3), 3, '0') END AS code FROM u"""


@query("sim_soundex", SOUNDEX_SQL)
def sim_soundex(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.soundex(F.col("p_name")).alias("code"))


@query("sim_jaro_winkler", "SELECT p_name, p_type, round(j + 0.1 * (1 - j) * (CASE WHEN substring(p_name, 1, 1) <> substring(p_type, 1, 1) THEN 0 WHEN substring(p_name, 1, 2) <> substring(p_type, 1, 2) THEN 1 WHEN substring(p_name, 1, 3) <> substring(p_type, 1, 3) THEN 2 WHEN substring(p_name, 1, 4) <> substring(p_type, 1, 4) THEN 3 ELSE 4 END), 6) AS s FROM (SELECT DISTINCT p_name, lower(p_type) AS p_type, jaro_similarity(p_name, lower(p_type)) AS j FROM part) t")
def sim_jaro_winkler(spark, sf):
    return table(spark, sf, "part").select("p_name", F.lower("p_type").alias("p_type")).distinct().select("p_name", "p_type", F.round(X.jaro_winkler(F.col("p_name"), F.col("p_type")), 6).alias("s"))


# --- domain rules -----------------------------------------------------------------------------------------------------------


def _rule(name: str, violation: Callable[[], Column], oracle: str):
    @query(name, oracle, "ledger")
    def run(spark, sf):
        return dirty(spark, sf, "ledger").withColumn("v", violation()).groupBy().agg(F.count_if("v").alias("violations"))


_rule("rule_not_null", lambda: K.not_null(q("currency")), "SELECT count(*) FILTER (currency IS NULL) AS violations FROM d")
_rule("rule_regex", lambda: K.regex("[A-Za-z0-9]{4,12}", q("account_code")), "SELECT count(*) FILTER (NOT regexp_full_match(account_code, '[A-Za-z0-9]{4,12}')) AS violations FROM d")
_rule("rule_enum", lambda: K.enum(["USD"], False, q("currency")), "SELECT count(*) FILTER (currency <> 'USD') AS violations FROM d")
_rule("rule_range", lambda: K.in_range(1, 30, q("debit")), "SELECT count(*) FILTER (debit < 1 OR debit > 30) AS violations FROM d")
_rule("rule_unique", lambda: K.unique(q("transaction_id"), q("line")), "SELECT count(*) AS violations FROM (SELECT count(*) OVER (PARTITION BY transaction_id, line) AS n FROM d) t WHERE n > 1")
_rule("rule_balanced", lambda: K.balanced(q("transaction_id"), q("debit"), q("credit"), 0.01), "SELECT count(*) AS violations FROM (SELECT abs(sum(debit - credit) OVER (PARTITION BY transaction_id)) AS g FROM d) t WHERE g > 0.01")
_rule("rule_not_future", lambda: K.not_future(F.lit("1999-01-01").cast("date"), q("date")), "SELECT count(*) FILTER (date > DATE '1999-01-01') AS violations FROM d")


@query("rule_monotonic", "SELECT count(*) FILTER (user_id <= p) AS violations FROM (SELECT user_id, lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id) AS p FROM events) t")
def rule_monotonic(spark, sf):
    return table(spark, sf, "events").withColumn("v", K.monotonic(q("event_type"), q("user_id"), "event_id")).agg(F.count_if("v").alias("violations"))


@query("rule_checkdigit", "SELECT k, (3 * (CAST(substring(s, 1, 1) AS INT) + CAST(substring(s, 3, 1) AS INT) + CAST(substring(s, 5, 1) AS INT) + CAST(substring(s, 7, 1) AS INT)) + CAST(substring(s, 2, 1) AS INT) + CAST(substring(s, 4, 1) AS INT) + CAST(substring(s, 6, 1) AS INT) + CAST(substring(s, 8, 1) AS INT)) % 10 = 0 AS ok FROM (SELECT p_partkey AS k, lpad(CAST(p_partkey * 7919 AS VARCHAR), 8, '0') AS s FROM part) t")
def rule_checkdigit(spark, sf):
    s = F.lpad((F.col("p_partkey") * 7919).cast("string"), 8, "0")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), X.mod10(s, (8,)).alias("ok"))


@query("domain_finance", "SELECT 'FIN-005' AS rule, count(*) FILTER (NOT regexp_full_match(currency, '[A-Z]{3}')) AS n FROM d UNION ALL SELECT 'FIN-002', count(*) FILTER (currency IS NULL) FROM d UNION ALL SELECT 'FIN-008', count(*) FILTER (NOT regexp_full_match(account_code, '[A-Za-z0-9]{4,12}')) FROM d", "ledger")
def domain_finance(spark, sf):
    got = domains.validate(dirty(spark, sf, "ledger"), "finance", as_of="2030-01-01")["violations"]
    return frame(spark, [(r, got[r]) for r in ("FIN-005", "FIN-002", "FIN-008")], "rule string, n long")


from quartzite import catalog_domains, catalog_more  # noqa: E402  they use nothing of this module

QUERIES |= catalog_domains.QUERIES | catalog_more.QUERIES
ORACLE_SQL |= catalog_domains.ORACLE_SQL | catalog_more.ORACLE_SQL
