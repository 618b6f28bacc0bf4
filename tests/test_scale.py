"""Steps that have to hold on larger tables: sums beyond 64 bits, order over many pieces, quantiles without value maps."""

import time
from contextlib import ExitStack

from pyspark.sql import functions as F

from quartzite import catalog
from quartzite.functions import text as X
from quartzite.operators import quality
from quartzite.operators.dedup import duplicate_rows, may_repeat
from quartzite.plans import cleaning, stats
from quartzite.plans.config import CleanOptions


def test_totals_beyond_64_bits(spark):
    wide = spark.range(900).select((F.col("id") % 7).cast("tinyint").alias("a"), (F.col("id") * 10**16).alias("wide"))
    got = {r.c: r for r in catalog.totals(wide).collect()}
    assert got["wide"].total == 404_550 * 10**16 and got["wide"].t == "bigint" and got["a"].total == sum(i % 7 for i in range(900))
    assert dict(catalog.totals(wide.limit(10)).dtypes)["total"] == "bigint"


def test_ordered_fill_over_pieces(spark, monkeypatch):
    monkeypatch.setattr(stats, "PIECE", 40)
    gaps = set(range(7)) | {50, 51} | set(range(120, 260)) | {499}
    rows = [(i, None if i in gaps else i // 3, i % 2 if i % 5 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, v long, zig long").repartition(5)
    o = CleanOptions(order_by="k")
    assert cleaning.time_order(df, ["v", "zig"], "k") == {"v": True, "zig": False}
    late = df.withColumn("v", F.expr("CASE WHEN k >= 400 THEN v - 100 ELSE v END"))
    assert cleaning.time_order(late, ["v"], "k") == {"v": False}
    out = cleaning.fill(df, [cleaning.Choice("v", "missing", "ordered_fill", "", "", "")], {"v"}, o)
    assert out.columns == ["k", "v", "zig", "v_was_missing"]
    got, last = {r.k: r.v for r in out.collect()}, next(v for _, v, _ in rows if v is not None)
    for k, v, _ in rows:
        last = last if v is None else v
        assert got[k] == last
    nulls = spark.createDataFrame([(None, 9), (3, None), (4, 1)], "k long, v long")
    assert sorted(r.v for r in cleaning.fill(nulls, [cleaning.Choice("v", "missing", "ordered_fill", "", "", "")], set(), o).collect()) == [1, 9, 9]


def test_ordered_fill_of_many_rows_ends(spark, sf):
    """Rows before the first value were filled in time with the square of the rows."""
    df = spark.range(300_000).select(F.col("id").alias("k"), F.when(F.col("id") == 299_999, 7).alias("v"))
    began = time.time()
    out = cleaning.fill(df, [cleaning.Choice("v", "missing", "ordered_fill", "", "", "")], set(), CleanOptions(order_by="k"))
    assert out.where("v = 7").count() == 300_000 and time.time() - began < 60


def test_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 3)
    monkeypatch.setattr(stats, "FINER", 8)
    rows = [((i * 37 % 1000) / 7 - 40, i * 10**12, float(i % 3), 1e-9 * i, 1e300 if i == 5 else -1e-300 * i, None, float("inf") if i % 2 else float("-inf") if i % 4 else float("nan")) for i in range(1000)]
    df = spark.createDataFrame(rows, "a double, b long, c double, d double, e double, f double, g double").repartition(3)
    at = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    want = df.agg(*(F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, at))).alias(c) for c in df.columns)).first()
    got = stats.quantiles(df, dict.fromkeys(df.columns, at))
    assert "f" not in got
    for c in got:
        assert list(map(repr, got[c].values())) == list(map(repr, want[c])), c


def test_no_value_maps(spark, monkeypatch):
    """A map of all values of a column was kept in one task."""
    monkeypatch.setattr(F, "percentile", None)
    df = spark.range(1000).select("id", (F.col("id") / 3).alias("x"))
    s = stats.describe(df)["x"]
    assert (s.q1, s.median, s.q3) == (83.25, 166.5, 249.75)


def test_comparison_repairs_once(spark, monkeypatch):
    calls, repair = [], cleaning.repair
    monkeypatch.setattr(cleaning, "repair", lambda *a: calls.append(1) or repair(*a))
    df = spark.range(60).selectExpr("id", "CASE WHEN id % 5 > 0 THEN id * 1.5D END AS price")
    got = cleaning.compare(df.union(df.limit(5)))
    assert [(r["strategy"], r["rows"], r["missing_left"]) for r in got] == [("conservative", 60, 12), ("balanced", 60, 0), ("aggressive", 60, 0)] and len(calls) == 1
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_drift_jobs_do_not_grow_with_numeric_columns(spark):
    few = spark.range(200).select("id", (F.col("id") * 0.5).alias("x"))
    wide = few.select("*", *((F.col("x") + i).alias(f"x{i}") for i in range(5)))
    (a, n), (b, m) = (jobs(spark, f"drift{len(df.columns)}", lambda df=df, base=quality.baseline(df): quality.drift(df.withColumn("x", F.col("x") + 90), base)) for df in (few, wide))
    assert n == m and a == b and {f["check"] for f in a} == {"ks", "psi"}


def test_profile_counts_repeated_values_before_parsing(spark, monkeypatch):
    given = []
    real = quality.suggest
    monkeypatch.setattr(quality, "suggest", lambda df, o, few, *a: given.append(list(few)) or real(df, o, few, *a))
    df = spark.range(100).selectExpr("id", "CASE WHEN id % 3 = 0 THEN ' N/A' WHEN id % 3 = 1 THEN ' 1.5 ' ELSE '2' END AS t", "CAST(id AS STRING) AS u", "CAST(NULL AS STRING) AS gone")
    got = {r.column: (r.suggested, r.distinct) for r in quality.profile(df).collect()}
    assert got == {"id": (None, 100), "t": ("double", 3), "u": ("bigint", 100), "gone": (None, 0)} and given == [["t", "gone"]]


def test_tables_without_duplicates_are_not_shuffled_whole(spark):
    df = spark.range(50).selectExpr("id", "id % 5 AS a", "CAST(NULL AS INT) AS b", "CAST(id AS STRING) AS c", "1.0D AS d")
    out, report = cleaning.clean(df, strategy="conservative", fix_dtypes=False, drop_empty_columns=False)
    assert "Aggregate" not in out._jdf.queryExecution().toString() and out.count() == 50
    twice = df.union(df.where("id < 7"))
    out, report = cleaning.clean(twice, strategy="conservative", fix_dtypes=False, drop_empty_columns=False)
    assert out.count() == 50 and [a.count for a in report.actions if a.step == "drop_duplicates"] == [7]
    assert duplicate_rows(df) == 0 and duplicate_rows(twice) == 7 and not may_repeat(df, df.columns) and may_repeat(twice, df.columns)


def test_strip_runs_its_pattern_only_at_need(spark):
    texts = ["", " ", "a", " a", "a\u3000", "\u00a0\n a b \t", "a b", "\u200b", "\x1c\x85x\u2028", None, "\ufeff a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(X.strip(F.col("t"))).collect()] == [None if t is None else t.strip() for t in texts]
    assert len(X.SPACES) == 29 and "CASE WHEN" in str(X.strip(F.col("t")))


def test_statistics_of_unfilled_columns_are_not_computed_again(spark, monkeypatch):
    asked, counted = [], []
    quantiles, modes = stats.quantiles, stats.mode_table
    monkeypatch.setattr(stats, "quantiles", lambda df, wanted: asked.append(list(wanted)) or quantiles(df, wanted))
    monkeypatch.setattr(stats, "mode_table", lambda df, columns, *a: counted.append([f.name for f in columns]) or modes(df, columns, *a))
    df = spark.range(200).selectExpr("id", "IF(id = 7, 9000, id % 50) AS far", "CASE WHEN id % 5 > 0 THEN id * 1.5D END AS x", "CASE WHEN id % 9 > 0 THEN id % 2 = 0 END AS b", "CASE WHEN id % 9 > 0 THEN concat('t', id % 3) END AS t")
    plan = cleaning.suggest_plan(df)
    assert asked == [["id", "far", "x"], ["x"]] and [x for x in counted if x] == [["id", "far", "b", "t"]]
    assert [(c.column, c.step, c.action) for c in plan] == [("x", "missing", "median"), ("b", "missing", "preserve"), ("t", "missing", "constant"), ("far", "outliers", "flag")]
    out, report = cleaning.clean(df)
    assert asked[2:] == [["id", "far", "x"], ["x"]] and out.where("far_outlier").count() == 1 and out.where("x is null").count() == 0
    filled = cleaning.fill(df, [c for c in plan if c.step == "missing"], set(), CleanOptions())
    alone, roles = cleaning.Report(), dict.fromkeys(df.columns, "numeric")
    cleaning.engine_outliers(filled, roles, CleanOptions(), alone)
    assert [a for a in report.actions if a.step == "outliers"] == alone.actions


def test_duplicates_go_in_one_shuffle(spark):
    """They were counted in one and removed in another."""
    df = spark.range(60).selectExpr("id", "CASE WHEN id % 5 > 0 THEN id * 1.5D END AS price")
    twice, gone = df.union(df.where("id < 9")), spark.createDataFrame([(None, None)], "id long, price double")
    for given, n in ((twice, 9), (df, 0), (twice.union(gone), 9)):
        out, report = cleaning.clean(given)
        assert [a.count for a in report.actions if a.step == "drop_duplicates"] == [n] * (n > 0) and out.count() == 60
        assert ("Aggregate" in out._jdf.queryExecution().toString()) == (n > 0) and not spark.sparkContext._jsc.getPersistentRDDs()
    with ExitStack() as hold:
        report = cleaning.Report()
        base = cleaning.repair(twice, CleanOptions(), report, hold)
        assert base.storageLevel.useMemory and base.count() == 60 and report.actions[-1].count == 9
    assert not base.storageLevel.useMemory


def test_lengths_and_words_are_taken_once_a_value(spark, monkeypatch):
    asked, aggregate = [], stats.aggregate
    monkeypatch.setattr(stats, "aggregate", lambda df, wanted: asked.append(list(wanted)) or aggregate(df, wanted))
    texts = ["", " ", "a", " a b ", "\ta\t b\n", "a\u00a0b", None, "x  y z", "x  y z", "\n"]
    df = spark.createDataFrame([(t, None, 1) for t in texts], "t string, gone string, n int")
    want = df.select(F.avg(F.length("t")), F.avg(F.size(F.split(F.trim("t"), "\\s+"))), F.min("t"), F.max("t")).first()
    s, plain = stats.describe(df), stats.describe(df, modes=["gone"])
    for got in (s["t"], plain["t"]):
        assert (got.length, got.spaces, got.min, got.max) == tuple(want)
    assert (s["gone"].length, s["gone"].spaces, s["t"].distinct, plain["t"].distinct) == (None, None, 8, None)
    assert not asked[1] and asked[3] == [("t", k) for k in ("min", "max", "length", "spaces")] and not {("t", "min"), ("t", "length")} & {*asked[0], *asked[2]}
