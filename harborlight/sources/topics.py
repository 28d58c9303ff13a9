"""Event sources: a Kafka topic, or files that stand in for one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harborlight.sources.derived import typed_events


def kafka(spark: SparkSession, servers: str, topic: str, per_trigger: int = 1_000_000, **options: str) -> DataFrame:
    """Messages of a topic from its beginning; needs the Kafka connector's jar."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .option("maxOffsetsPerTrigger", str(per_trigger))
        .options(**options)
        .load()
        .select(F.col("value").cast("string").alias("value"))
    )


def parquet_stream(spark: SparkSession, path: str, schema: StructType, files: int | None = None) -> DataFrame:
    """A file or a growing folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", str(files))
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(jvm_path).isDirectory():
        return reader.parquet(path)
    folder, name = path.rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def event_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Typed events of an events table, with a time that can carry a watermark."""
    schema = spark.read.parquet(path).schema
    raw = parquet_stream(spark, path, schema, files)
    return typed_events(raw.withColumn("ts", F.col("ts").cast("timestamp")))


def as_messages(events: DataFrame) -> DataFrame:
    """Typed events as the JSON text a topic would carry, one malformed in 500."""
    fields = [c for c in events.columns if c != "expected_delivery"]
    body = F.to_json(F.struct(*fields, F.date_format("event_time", "yyyy-MM-dd").alias("expected_delivery")))
    cut = F.col("event_id") % 500 == 499
    return events.select(
        "event_id", F.when(cut, F.substring(body, 1, 20)).otherwise(body).alias("value"))
