"""Reading and writing tables by path and format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = {".csv": "csv", ".parquet": "parquet", ".pq": "parquet", ".json": "json", ".jsonl": "json", ".orc": "orc", ".arrow": "arrow", ".feather": "arrow", ".ipc": "arrow"}


def format_of(path: str, fmt: str | None = None) -> str:
    if fmt:
        return fmt
    for end, name in FORMATS.items():
        if path.lower().rstrip("/").endswith(end):
            return name
    raise ValueError(f"cannot tell the format of {path!r}; give fmt")


def read(spark: SparkSession, path: str, fmt: str | None = None, **options) -> DataFrame:
    """CSV comes as text throughout: types are inferred by the clean, not by the reader."""
    kind = format_of(path, fmt)
    if kind == "csv":
        return spark.read.options(header=True, inferSchema=False, **options).csv(path)
    if kind == "arrow":
        # one small file; the rows go to Spark as Arrow batches
        import pyarrow.feather

        return spark.createDataFrame(pyarrow.feather.read_table(path))
    return spark.read.options(**options).format(kind).load(path)


def write(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite", **options) -> None:
    kind = format_of(path, fmt)
    writer = df.write.mode(mode).options(**options)
    if kind == "csv":
        writer.options(header=True).csv(path)
    else:
        writer.format(kind).save(path)


def read_jdbc(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    """A warehouse table; ``partitionColumn``, bounds and ``numPartitions`` in options split the read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def clean_csv(spark: SparkSession, path: str, output: str | None = None, **options):
    from quartzite.plans.cleaning import clean

    out, report = clean(read(spark, path, "csv"), **options)
    if output:
        write(out, output, "csv")
    return out, report


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def stream_kafka(spark: SparkSession, servers: str, topic: str, schema, **options) -> DataFrame:
    """JSON messages of a topic as columns; needs the Kafka connector on the class path."""
    from pyspark.sql import functions as F

    raw = spark.readStream.format("kafka").options(**{"kafka.bootstrap.servers": servers, "subscribe": topic, **options}).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("m")).select("m.*")
