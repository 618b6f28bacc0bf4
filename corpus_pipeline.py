"""The corpus pipeline: each stage works on all that the stage before kept, by one of the operators in quartzite.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm._shared import documents, stored
from quartzite.llm.line_dedup import dedup_lines
from quartzite.llm.minhash_dedup import near_duplicates
from quartzite.llm.sentencepiece_fst import encode
from quartzite.llm.source_mixing import mixed
from quartzite.llm.toxicity import reject_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return reject_toxic(docs.select(*COLUMNS), labels)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go from all of them. Copies count as one document here: near_dedup keeps one of
    them, with its text. A document with nothing else left stays, empty."""
    return dedup_lines(docs.select(*COLUMNS), copies_once=True).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, similarity 0.8 or more."""
    gone = near_duplicates(docs.select("doc_id", "text"), width=5).where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    # the build side is a list of ids; the texts are hashed by id and never sorted
    return docs.select(*COLUMNS).join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col("gone"), "left_anti")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of languages in demand are repeated until the token shares match the targets; none is lost."""
    return mixed(docs.select(*COLUMNS))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text again."""
    return encode(docs.select("doc_id", "text")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("source_mixing", source_mixing), ("sentencepiece", sentencepiece)]

#: Classifiers and the tokenizer cannot be expressed in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs, _ = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
