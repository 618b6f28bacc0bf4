import corpus_pipeline as P
from quartzite.llm.sentencepiece_fst import decode

SF = "/root/testdata/sf0.01"
NAMES = ["toxicity", "line_dedup", "near_dedup", "source_mixing", "sentencepiece"]


def test_stages_in_order(spark):
    assert [n for n, _ in P.STAGES] == NAMES and P.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    kept = P.toxicity(spark, docs, SF)
    assert kept.columns == P.COLUMNS and 0.8 * len(before) < kept.count() < len(before)
    lines = P.line_dedup(spark, kept, SF)
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert lines.columns == P.COLUMNS and len(texts) > 0.97 * kept.count()
    assert all(set(t.split("\n")) <= set(before[i].split("\n")) for i, t in texts.items())

    def shingles(t):
        w = t.encode().lower().split()
        return frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    near = P.near_dedup(spark, lines, SF)
    left = {r.doc_id for r in near.collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    alike = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    assert near.columns == P.COLUMNS
    ids = sorted(left)
    assert not any(alike(sets[a], sets[b]) for n, a in enumerate(ids) for b in ids[:n])
    gone = set(texts) - left
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(sorted(texts)):
        for b in sorted(texts)[:n]:
            if alike(sets[a], sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert gone == {i for i in texts if find(i) != i}
    mixed = P.source_mixing(spark, near, SF)
    assert mixed.columns == P.COLUMNS and {r.doc_id for r in mixed.collect()} == left
    tokens = P.sentencepiece(spark, near, SF)
    assert tokens.where("not round_trip").count() == 0
    assert {(r.doc_id, r.text) for r in decode(tokens).collect()} == {(i, texts[i]) for i in left}


def test_one_of_many_copies_keeps_its_text(spark):
    clean = "\n".join(f"line {i} of a clean text about rivers and hills number {i}" for i in range(6))
    alike = [clean, clean.upper(), clean.replace("\n", " \n\t")]  # the same lines by their keys
    rows = [(i, alike[i % 3]) for i in range(15)] + [(20 + i, f"All rights reserved.\nown words {i} only in this one") for i in range(10)] + [(40, "All rights reserved.")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    lines = P.line_dedup(spark, docs, SF)
    texts = {r.doc_id: r.text for r in lines.collect()}
    assert texts == dict(rows[:15]) | {20 + i: f"own words {i} only in this one" for i in range(10)} | {40: ""}
    assert {r.doc_id: r.n_chars for r in lines.collect()} == {i: len(t) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in P.near_dedup(spark, lines, SF).collect()} == {i: t for i, t in texts.items() if i not in range(1, 15)}


def test_odd_tables(spark, odd_docs, no_docs, tmp_path):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids", "round_trip"]
    no_docs.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
