import numpy as np

from quartzite.llm.knn_join import op5_topk, plan, top_k


def brute(rows, k=20):
    good = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % 20 == 0:
            score = lambda b, a=a: max(min(sum(x * y for x, y in zip(a, b, strict=False)), (1 << 63) - 1), -(1 << 63))
            found = sorted((-score(b), i) for i, b in good if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_matches_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op5_topk(spark, sf).collect())) == brute(rows)


def test_tight_groups_ties_and_bad_vectors(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8)) * 20
    rows = [(i, (centres[i % 6] + r.normal(size=8) * 0.05).tolist()) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(300)] + [(2000, None), (2020, [None] * 8), (2040, [float("nan")] * 8), (2060, [float("inf")] + [0.0] * 7), (None, rows[1][1])]
    df = frame(spark, rows)
    assert sorted(map(tuple, top_k(df, pivots=12, block=100, query_block=7).collect())) == brute(rows)
    assert top_k(df.limit(0)).count() == 0 and top_k(df.where("vec_id % 20 = 1")).count() == 0
    assert top_k(df.where("vec_id in (0, 20, 40)"), k=5).count() == 6


def test_rows_go_only_where_they_are_needed(spark):
    """Groups far apart: next to nothing is replicated, and the result is whole."""
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 16)) * 30
    rows = [(i, (centres[i // 20 % 40] + r.normal(size=16) * 0.2).tolist()) for i in range(4000)]
    df = frame(spark, rows)
    sent, _ = plan(df, query_block=10)
    groups = sent.select("g").distinct().count()
    data = sent.where("key < 0").count()
    assert groups >= 20 and data < 0.25 * groups * len(rows)
    assert sorted(map(tuple, top_k(df, query_block=10).collect())) == brute(rows)


def test_repeated_ids(spark):
    r = np.random.default_rng(6)
    rows = [(i, r.normal(size=4).tolist()) for i in range(200)] + [(40, r.normal(size=4).tolist()) for _ in range(60)]
    got = sorted(map(tuple, top_k(frame(spark, rows), pivots=16, query_block=4).collect()))
    assert got == brute(rows) and sum(q == 40 for q, *_ in got) == 61 * 20


def test_large_components_and_other_lengths(spark):
    rows = [(0, [1.5e10, 1.0]), (1, [1.5e10, 2.0]), (2, [-3e15, 1.0]), (3, [1e200, 1.0]), (20, []), (21, [0.5]), (22, [0.25, 0.5, 0.75]), (40, [9e15, -1.0, 3.0])]
    assert sorted(map(tuple, top_k(frame(spark, rows)).collect())) == brute(rows)
    assert top_k(frame(spark, [(0, []), (1, [])])).collect()[0].score == 0
