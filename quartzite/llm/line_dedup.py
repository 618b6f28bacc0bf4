"""Corpus-wide line deduplication by levelled sorted runs of line hashes.

The state is a log-structured merge index: every batch of documents is reduced to a *run*, a table of
(line hash, number of documents with it), dealt to buckets by hash and sorted in each, one file a bucket. Runs of one level are compacted
into one run of the next as soon as ``fanout`` of them exist. A new batch, reduced and dealt in the same way, is merge-anti-joined with the
runs (a line that a run already has in enough documents is settled and needs no more counting) and then adds its own run. As all
runs have the same buckets, neither the anti joins nor compaction shuffle a run again; Spark's merge does sort the buckets once more, which
costs one pass over what is in order already. A batch is reduced before it meets the runs, so that a very common line is one row there.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys are compared by
two independent 64-bit hashes. Main path: DataFrame functions only.

Defined cases: a null text is one empty line and is returned as an empty text; an empty table gives an empty result; repeated
rows of one doc_id count as one document for the frequencies and each gives its own result row; rows
without doc_id count as one document together; other columns pass through ``dedup_lines`` untouched.
With ``copies_once``, texts with the same keys in the same order count as one document whatever their ids, so that a text is not
emptied for its copies' sake; each distinct text of one doc_id, or without any, then counts.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ascii_lower, discard, documents, few, let, on_files, scratch_root, stored

#: Frequent lines that may be broadcast: 16 MB. Beyond, their join shuffles, and Spark splits what is hot.
LINES = 1_000_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


@dataclass
class RunIndex:
    """Sorted runs of (h1, h2, n_docs) by level, kept as bucketed tables in the shared folder until ``close``."""

    spark: SparkSession
    fanout: int = 3
    buckets: int = 0
    levels: list[list[tuple[str, str]]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.buckets = self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        # Spark 4.1 plans a union of columnar scans as if it kept the buckets together, and then does not; behind a filter, which works on rows, it does
        out, *rest = (run.where("n_docs > 0") for run in runs)
        for run in rest:
            out = out.unionByName(run)
        return out.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")) if len(runs) > 1 else out

    def dealt(self, counts: DataFrame) -> DataFrame:
        return counts.repartition(self.buckets, "h1", "h2")

    def open_lines(self, counts: DataFrame, settled: int) -> DataFrame:
        """Rows of ``counts`` (h1, h2, ...) whose line no run has in ``settled`` documents: a settled line is decided for good, so later runs leave it out."""
        for run in self.runs():
            counts = counts.join(run.where(F.col("n_docs") >= settled).select("h1", "h2"), ["h1", "h2"], "left_anti")
        return counts

    def add(self, counts: DataFrame, level: int = 0) -> None:
        """Store ``counts``, dealt to the buckets, as one run; compact the level when it is full."""
        while len(self.levels) <= level:
            self.levels.append([])
        name = f"quartzite_run_{uuid.uuid4().hex}"
        path = f"{scratch_root(self.spark)}/quartzite/{name}"
        counts.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        files, target = on_files(self.spark, path)
        files.deleteOnExit(target)
        self.levels[level].append((name, path))
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self.add(self.dealt(self.merged([self.spark.table(n) for n, _ in full])), level + 1)
            self.drop(full)

    def drop(self, runs: list[tuple[str, str]]) -> None:
        for name, path in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            discard(self.spark, path)

    def close(self) -> None:
        for level in self.levels:
            self.drop(level)
        self.levels = []


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 5, fanout: int = 3, text_col: str = "text", id_col: str = "doc_id", copies_once: bool = False) -> DataFrame:
    """``docs`` with ``text_col`` rid of the lines whose key is in ``min_docs`` documents or more, and with
    ``_n_lines`` and ``_n_dropped``. Keys shorter than ``min_chars`` code points always stay."""
    spark = docs.sparkSession
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    # what counts as one document
    own = (F.xxhash64(F.transform(lines_of(text), line_key)) if copies_once else ident).alias("own")
    keyed = (
        docs.select(ident.alias("id"), F.xxhash64(text).alias("th"), own, text.alias("text"))  # once a document, not once a line
        .select("id", "th", "own", F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
        .select("id", "th", "own", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_chars)
        .select("id", "th", "own", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(8191), F.col("key")).alias("h2"), F.pmod(F.xxhash64("own"), F.lit(batches)).cast("int").alias("batch"))
    )
    keyed, _ = stored(keyed, "lines")
    index = RunIndex(spark, fanout)
    for i in range(batches):
        batch = keyed.where(F.col("batch") == i).select("h1", "h2", "own").distinct()
        index.add(index.open_lines(index.dealt(batch.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))), min_docs))
    frequent, _ = stored(index.merged(index.runs()).where(F.col("n_docs") >= min_docs).select("h1", "h2"), "frequent")
    index.close()
    hit = keyed.join(few(frequent, LINES), ["h1", "h2"], "left_semi").groupBy("id", "th").agg(F.collect_set("pos").alias("_hit"))
    # the document is one struct, so that no name of its columns can clash with ours
    rows = docs.select(F.struct("*").alias("row"), ident.alias("id"), F.xxhash64(text).alias("th"))
    hit = hit.hint("shuffle_hash").withColumnsRenamed({"id": "hit_id", "th": "hit_th"})
    out = rows.join(hit, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    text = F.col(f"row.`{text_col}`")
    gone, lines = F.coalesce(F.col("_hit"), F.array().cast("array<int>")), lines_of(text)
    keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    joined = let(lines, lambda own: F.array_join(F.transform(keep, lambda i: F.get(own, i)), "\n"))
    kept = F.when(F.col("_hit").isNull(), F.coalesce(text, F.lit(""))).otherwise(joined)
    columns = [kept.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns]
    return out.select(*columns, F.size(lines).cast("long").alias("_n_lines"), F.size(gone).cast("long").alias("_n_dropped"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.col("text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, 1 + len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
