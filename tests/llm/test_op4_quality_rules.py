from quartzite.llm.quality_rules import fit, op4_quality_rules, posterior, quality


def brute(text):
    text = text or ""
    words = text.encode().split()
    w = [x.decode() for x in words]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    again = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    n = len(w)
    return n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), n < 50 or 100 * len(again) > 50 * n


def test_statistics_match_brute_force(spark):
    at = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    rows = op4_quality_rules(spark, at).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    seen = [(labels[r.doc_id], r.kept, r.base_failed) for r in rows if r.doc_id in labels]
    good, bad = [k for q, k, f in seen if q and not f], [k for q, k, _ in seen if not q]
    print(len(good), sum(good), len(bad), sum(bad))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.5 * len(bad)


def test_em_finds_the_accuracies():
    import random

    r = random.Random(5)
    truth = [(0.9, 0.8), (0.7, 0.9), (0.8, 0.75)]
    counts = {}
    for _ in range(20000):
        y = r.random() < 0.7
        v = tuple(1 if (r.random() < g) == y or (y and False) else -1 for g, _ in truth)
        counts[v] = counts.get(v, 0) + 1
    good, table = fit(sorted(counts.items()))
    assert abs(good - 0.7) < 0.08 and all(abs(t[1][1] - g) < 0.08 for t, (g, _) in zip(table, truth, strict=True))
    assert posterior((1, 1, 1), good, table) > 0.9 > 0.2 > posterior((-1, -1, -1), good, table)


def test_odd_rows(odd_docs, no_docs):
    got = quality(odd_docs).collect()
    assert len(got) == 11 and all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3, 4, None))
    assert next(r for r in got if r.doc_id == 8).n_repeat_words == 100000
    assert quality(no_docs).count() == 0
