"""Labelled rows for the classifiers: a bounded sample, joined with the texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold_of(doc_id: Column, folds: int = 5) -> Column:
    """crc32(doc_id as text) mod ``folds``; rows without doc_id are in fold 1."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds, F.lit(1)).cast("int")


def labelled_sample(docs: DataFrame, labels: DataFrame, targets: list[str], bound: int, held_out: int | None = 0) -> DataFrame:
    """doc_id, text, fold and ``targets`` (0/1) of at most ``bound`` labelled documents, the ones with the least hash of
    doc_id; rows of fold ``held_out`` are never among them. A document with several label rows gets their rounded mean.

    The sample's ids are at most ``bound`` rows, so they may be broadcast; the texts are read in one scan.
    """
    known = F.col("doc_id").isNotNull()
    for t in targets:
        known = known & F.col(t).isin(0, 1)
    rows = labels.select("doc_id", *targets).where(known).withColumn("fold", fold_of(F.col("doc_id")))
    if held_out is not None:
        rows = rows.where(F.col("fold") != held_out)
    one = rows.groupBy("doc_id").agg(F.first("fold").alias("fold"), *(F.round(F.avg(t)).cast("int").alias(t) for t in targets))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    texts = docs.select(F.col("doc_id"), F.col("text"))
    return texts.join(F.broadcast(sample), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "fold", *targets)
