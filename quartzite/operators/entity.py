"""Entity resolution: blocking by equi-joins, comparisons as expressions, clusters by label propagation."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzite.functions import text as X
from quartzite.plans.stats import q

KINDS = ("exact", "jaro_winkler", "levenshtein", "soundex", "numeric_distance", "date_distance", "custom_sql")


@dataclass(frozen=True)
class Comparison:
    column: str
    kind: str
    weight: float = 1.0
    threshold: float = 1.0

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"unknown comparison {self.kind!r}")


@dataclass(frozen=True)
class Resolution:
    """``blocking`` has one list of key expressions for each rule; rows meet that agree on all keys of a rule."""

    id_column: str
    blocking: list[list[str]]
    comparisons: list[Comparison]
    match: float = 0.85
    possible: float = 0.65
    max_pairs: int = 50_000_000
    link_only: bool = False

    def __post_init__(self) -> None:
        if not self.blocking or not self.comparisons:
            raise ValueError("blocking and comparisons must not be empty")
        if not 0 <= self.possible <= self.match <= 1:
            raise ValueError("need 0 <= possible <= match <= 1")


def similarity(a: Column, b: Column, c: Comparison) -> Column:
    if c.kind == "exact":
        s = F.when(a.cast("string") == b.cast("string"), 1.0).otherwise(0.0)
    elif c.kind == "jaro_winkler":
        s = X.jaro_winkler(a.cast("string"), b.cast("string"))
    elif c.kind == "levenshtein":
        s = X.levenshtein_similarity(a.cast("string"), b.cast("string"))
    elif c.kind == "soundex":
        s = F.when(X.soundex(a.cast("string")) == X.soundex(b.cast("string")), 1.0).otherwise(0.0)
    elif c.kind == "numeric_distance":
        s = F.greatest(F.lit(0.0), 1 - F.abs(a.cast("double") - b.cast("double")) / c.threshold)
    else:
        s = F.greatest(F.lit(0.0), 1 - F.abs(F.datediff(a, b)) / c.threshold)
    return F.when(a.isNull() | b.isNull(), 0.0).otherwise(s)


def pair_count(df: DataFrame, r: Resolution) -> int:
    """Pairs that blocking would make, from key histograms; no join is run for it."""
    total = 0
    for keys in r.blocking:
        k = [F.expr(e) for e in keys]
        n = df.where(filled(k)).groupBy(*(x.alias(f"k{i}") for i, x in enumerate(k))).agg(F.count(F.lit(1)).alias("n"))
        total += n.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0))).first()[0]
    return int(total)


def filled(keys: list[Column]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & k.isNotNull() & (k.cast("string") != "")
    return out


def candidates(df: DataFrame, r: Resolution, source: str | None = None) -> DataFrame:
    """left_id and right_id: pairs of rows that some blocking rule brings together, each once; left is the smaller by text."""
    if (n := pair_count(df, r)) > r.max_pairs:
        raise ValueError(f"blocking makes {n} pairs, more than max_pairs = {r.max_pairs}")
    out = None
    for keys in r.blocking:
        k = [F.expr(e) for e in keys]
        side = df.where(filled(k)).select(q(r.id_column).cast("string").alias("id"), *(x.alias(f"k{i}") for i, x in enumerate(k)), *([q(source).alias("src")] if source else []))
        a, b = side.alias("a"), side.alias("b")
        on = F.lit(True)
        for i in range(len(k)):
            on = on & (F.col(f"a.k{i}") == F.col(f"b.k{i}"))
        on = on & (F.col("a.id") < F.col("b.id"))
        if source and r.link_only:
            on = on & (F.col("a.src") != F.col("b.src"))
        pairs = a.join(b, on).select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"))
        out = pairs if out is None else out.union(pairs)
    return out.distinct()


def scores(df: DataFrame, pairs: DataFrame, r: Resolution) -> DataFrame:
    """left_id, right_id, a similarity for each comparison, score, log_odds and decision."""
    used = [c for c in r.comparisons if c.kind != "custom_sql"]
    columns = list(dict.fromkeys(c.column for c in used))
    side = lambda s: df.select(q(r.id_column).cast("string").alias(f"{s}_id"), *(q(c).alias(f"{s}_{i}") for i, c in enumerate(columns)))
    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    both = both.select("left_id", "right_id", *(similarity(F.col(f"left_{columns.index(c.column)}"), F.col(f"right_{columns.index(c.column)}"), c).alias(f"sim_{i}") for i, c in enumerate(used)))
    whole = sum(c.weight for c in used)
    score = sum((F.col(f"sim_{i}") * c.weight for i, c in enumerate(used)), F.lit(0.0)) / whole
    odds = sum(((2 * F.col(f"sim_{i}") - 1) * c.weight for i, c in enumerate(used)), F.lit(0.0))
    out = both.withColumns({"score": score, "log_odds": odds})
    return out.withColumn("decision", F.when(F.col("score") >= r.match, "match").when(F.col("score") >= r.possible, "possible").otherwise("non_match"))


def on_files(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write ``df`` to the folder that driver and executors share, and read it back; what is left goes when the driver ends."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quartzite-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root}/quartzite/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = on_files(spark, path)
    files.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove written tables that nothing reads any more."""
    for path in paths:
        files, target = on_files(spark, path)
        files.delete(target, True)


def components(edges: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id is connected with; labels are written after each step."""
    spark = edges.sparkSession
    both = edges.select("left_id", "right_id").union(edges.select(F.col("right_id"), F.col("left_id"))).toDF("a", "b").distinct()
    both, at_both = stored(both)
    labels, at = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("root")))
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        step = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        above = step.select(F.col("id").alias("root"), F.col("root").alias("above"))
        new, at_new = stored(step.join(above, "root").select("id", F.least("root", "above").alias("root"), (F.least("root", "above") != F.col("old")).alias("moved")))
        discard(spark, at)
        labels, at = new.select("id", "root"), at_new
        if not new.where("moved").limit(1).count():
            discard(spark, at_both)
            return labels


def resolve(df: DataFrame, r: Resolution, source: str | None = None) -> DataFrame:
    """``df`` with cluster_id (er_000001, ... by smallest id), is_canonical: the row of a cluster with the fewest missing cells."""
    ids = df.select(q(r.id_column).cast("string").alias("id"))
    if ids.count() != ids.distinct().count():
        raise ValueError(f"{r.id_column} is not unique")
    found = scores(df, candidates(df, r, source), r).where("decision = 'match'")
    roots = components(found)
    rows = df.select(F.struct("*").alias("row"), q(r.id_column).cast("string").alias("id"), sum((q(c).isNull().cast("int") for c in df.columns), F.lit(0)).alias("gaps"))
    rows = rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    # numbers for clusters: ranks within ranges of the roots plus the ranges' offsets, no single-partition window over all rows
    named = rows.select("root").distinct()
    order = numbered(named, "root")
    best = rows.groupBy("root").agg(F.min(F.struct("gaps", "id")).alias("best"))
    out = rows.join(order, "root").join(best, "root")
    return out.select("row.*", F.format_string("er_%06d", F.col("number")).alias("cluster_id"), (F.col("id") == F.col("best.id")).alias("is_canonical"))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """``column`` and its rank from 1, by range partitions: only their sizes meet on the driver."""
    ranged, _ = stored(df.repartitionByRange(q(column)).sortWithinPartitions(q(column)).withColumn("_part", F.spark_partition_id()))
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = {}, 0
    for p, n in sizes:
        offsets[p] = total
        total += n
    if not offsets:
        return ranged.select(column, F.lit(0).cast("long").alias("number"))
    base = F.element_at(F.create_map(*(F.lit(x) for p, n in offsets.items() for x in (p, n))), F.col("_part"))
    return ranged.select(column, (F.row_number().over(Window.partitionBy("_part").orderBy(column)) + base).cast("long").alias("number"))


def link(left: DataFrame, right: DataFrame, r: Resolution) -> DataFrame:
    """Clusters over two tables; ids must be unique over both."""
    both = left.withColumn("_source", F.lit("left")).unionByName(right.withColumn("_source", F.lit("right")), allowMissingColumns=True)
    return resolve(both, r, "_source")

