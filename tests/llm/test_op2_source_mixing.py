from quartzite.llm.source_mixing import TARGETS, mixed, mixture, op2_source_mixing


def test_expected_totals_match_targets(spark):
    rows = op2_source_mixing(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    totals = {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) for d in TARGETS}
    whole = sum(totals.values())
    assert all(abs(totals[d] / whole - t) < 0.005 for d, t in TARGETS.items())
    assert all(r.rate >= 1 and r.copies in (int(r.rate), int(r.rate) + 1) and abs(sum(r[f"p_{d}"] for d in TARGETS) - 1) < 1e-6 for r in rows)
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert sum(max(TARGETS, key=lambda d: r[f"p_{d}"]) == lang[r.doc_id] for r in rows) > 970


def test_lower_bound_and_given_total(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out, domains = mixture(docs, {"en": 0.1, "fr": 0.9}, total=1000.0, least=0.0)
    rows = out.collect()
    assert domains == ["en", "fr"] and all(r.rate >= 0 for r in rows)
    assert abs(sum(r.rate * r.tokens * r.p[1] for r in rows) - 900) < 5


def test_odd_rows(odd_docs, no_docs):
    out = mixed(odd_docs)
    assert out.columns == odd_docs.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in odd_docs.collect()}
    assert mixed(no_docs).count() == 0
