import hashlib
from collections import defaultdict

from quartzite.llm.line_dedup import RunIndex, dedup_lines, op8_line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=10):
    lines = {i: (text or "").split("\n") for i, text in rows}
    key = lambda x: x.strip(" \t\n\v\f\r").translate(LOWER)
    seen = defaultdict(set)
    for i, own in lines.items():
        for x in own:
            seen[key(x)].add(i)
    keep = {i: [x for x in own if not key(x) or len(seen[key(x)]) < least] for i, own in lines.items()}
    return sorted((i, len(own), len(own) - len(keep[i]), hashlib.sha256("\n".join(keep[i]).encode()).hexdigest()) for i, own in lines.items())


def test_matches_brute_force(spark):
    at = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
    assert sorted(map(tuple, op8_line_dedup(spark, at).collect())) == brute(rows)


def test_many_levels(spark):
    rows = [(i, f"Shared {i % 3}\t\nown {i}\n\n shared {i % 3}\r\nÄ{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r._n_lines, r._n_dropped, hashlib.sha256(r.text.encode()).hexdigest()) for r in dedup_lines(df, batches=9, fanout=2).collect()]
    assert sorted(got) == brute(rows)


def test_odd_rows(odd_docs, no_docs):
    out = dedup_lines(odd_docs, min_docs=2)
    assert out.columns[: len(odd_docs.columns)] == odd_docs.columns
    got = [(r.doc_id, r._n_lines, r._n_dropped, r.text) for r in out.collect()]
    assert len(got) == 11 and (1, 1, 0, "") in got and (4, 1, 1, "") in got and got.count((7, 1, 1, "")) == 2
    assert dedup_lines(no_docs).count() == 0


def test_runs_merge_without_shuffles(spark):
    """Anti joins with runs and their compaction read the buckets as they are; the levels fill up as they should."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        index = RunIndex(spark, fanout=2, buckets=4)
        count = lambda lo: spark.range(lo, lo + 100).selectExpr("id as h1", "id * 7 as h2", "1 + id % 3 as n_docs")
        for i in range(5):
            index.add(index.open_lines(index.dealt(count(50 * i)), 3))
        assert [len(level) for level in index.levels] == [1, 0, 1]
        plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan(index.merged(index.runs()))
        assert plan(index.open_lines(index.dealt(count(0)), 3)).count("Exchange") == 1
        got = {r.h1: r.n_docs for r in index.merged(index.runs()).collect()}
        # a line met twice counts twice, unless it was settled the first time
        assert got == {i: (1 + i % 3) * (2 if i % 3 < 2 and 50 <= i < 250 else 1) for i in range(300)}
        names = [name for level in index.levels for name, _ in level]
        index.close()
        assert not any(spark.catalog.tableExists(n) for n in names)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
