"""What the corpus operators share: scratch tables in the cluster's shared folder, and reading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators: space, and tab to carriage return.
WS = "\\x20\\x09-\\x0D"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset in a single process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="quartzite-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def on_files(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def stored(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors. The driver removes what is
    left of such tables when it ends; ``discard`` removes them sooner."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quartzite/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, target = on_files(spark, path)
    files.deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Remove scratch tables that nothing reads any more."""
    for path in paths:
        files, target = on_files(spark, path)
        files.delete(target, True)


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if a count finds at most ``rows`` rows; otherwise as it is, so that a join shuffles it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``: an expression that is used often inside lambdas is evaluated once a row."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{WS}]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
