import zlib

import numpy as np

from quartzite.llm.quality_classifier import isotonic, op10_quality_classifier
from quartzite.llm.quality_classifier import score as quality_score
from quartzite.llm.toxicity import reject_toxic
from quartzite.llm.toxicity import score as toxicity_score

SF = "/root/testdata/sf0.1"


def test_quality_on_held_out_labels(spark):
    rows = op10_quality_classifier(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    good, bad = [p for q, p in held if q], [p for q, p in held if not q]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_toxicity_on_labels_it_has_not_seen(spark):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    unseen = F.crc32(F.col("doc_id").cast("string")) % 4 == 0
    rejected = {r.doc_id: r.rejected for r in toxicity_score(docs, labels.where(~unseen), bound=3000).select("row.doc_id", "rejected").collect()}
    rows = labels.where(unseen).collect()
    toxic, clean = [rejected[r.doc_id] for r in rows if r.toxic], [rejected[r.doc_id] for r in rows if not r.toxic]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.02


def test_toxicity_of_rare_terms_by_language(spark):
    small = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity_score(docs, labels).select("row.doc_id", "row.lang", "rejected").collect() if r.doc_id in toxic]
    for lang in ("en", "de", "fr", "es"):
        assert np.mean([r.rejected for r in rows if toxic[r.doc_id] and r.lang == lang]) > 0.6
    assert np.mean([r.rejected for r in rows if not toxic[r.doc_id]]) < 0.03


def test_isotonic_is_monotone_least_squares():
    x, y = isotonic(np.array([1.0, 2, 3, 4, 5, 6]), np.array([0, 1, 0, 0, 1, 1.0]))
    assert (np.diff(y) >= 0).all() and x[0] == 1 and x[-1] == 6
    assert abs(np.interp(3, x, y) - (1 + 0.5) / 4) < 1e-9


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 1, 0), (6, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert quality_score(odd_docs, labels).count() == 11 and quality_score(odd_docs, labels.limit(0)).select("score").distinct().count() == 1
    assert quality_score(no_docs, labels).count() == 0
    kept = reject_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns and kept.count() <= 11
    assert reject_toxic(odd_docs, labels.limit(0)).count() == 11 and reject_toxic(no_docs, labels).count() == 0
