import numpy as np
from pyspark.sql import functions as F

from quartzite.llm.minhash_dedup import near_duplicates, op1_minhash, sketch


def brute(rows):
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d), find(d) == d) for d in ids)


def test_matches_brute_force(spark):
    for sf in ("sf0.001", "sf0.01"):
        at = f"/root/testdata/{sf}"
        docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect()
        assert sorted(tuple(r) for r in op1_minhash(spark, at).collect()) == brute(docs)


def test_chains_and_crowded_buckets(spark, monkeypatch):
    """Copies that differ from each other step by step: links that the first member of a bucket does not have."""
    monkeypatch.setattr("quartzite.llm.minhash_dedup.IDS", 10)
    rng = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(60)], []
    for i in range(120):
        base = list(base)
        base[int(rng.integers(60))] = f"x{i}"
        rows.append((1000 - i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_outsiders_of_a_large_component(spark, monkeypatch):
    """Many copies at distances around the threshold: linked to some of a component only, to each other only, or to nothing."""
    monkeypatch.setattr("quartzite.llm.minhash_dedup.BLOCK", 7)
    rng = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(80)], []
    for i in range(150):
        words = list(base)
        for j in rng.choice(80, int(rng.integers(1, 11)), replace=False):
            words[j] = f"x{i}_{j}"
        rows.append((int(rng.integers(1 << 40)), " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept")
    want = brute(rows)
    assert len({w[2] for w in want}) > 5
    assert sorted(tuple(r) for r in got.collect()) == want


def test_one_id_with_several_texts(spark):
    """Each text of an id is compared, whatever the order in which they come."""
    base = [f"w{i}" for i in range(60)]
    one, two = " ".join(base), " ".join(f"v{i}" for i in range(60))
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, "more " + two), (5, "nothing of that kind")]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 5)}


def test_odd_rows(spark, odd_docs, no_docs):
    got = {}
    for r in near_duplicates(odd_docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == got[1][:1] and got[1][0] == (0, 1, True) and got[3] == [(0, 3, True)]
    assert got[4] == [(1, 4, True)] and got[5] == [(1, 4, False)]
    assert got[7] == [(10, 6, False)] * 2 and got[9] == [(6, 8, False)] and got[None] == [(3, None, True)]
    assert near_duplicates(no_docs).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a, b = pool[:500], pool[100:600]
    agree = np.mean([np.mean(sketch(a ^ np.uint64(s), 160) == sketch(b ^ np.uint64(s), 160)) for s in range(1, 20)])
    assert abs(agree - 400 / 600) < 0.03
    assert len(set(sketch(pool[:1], 160).tolist())) == 160
