"""Running a stream over all it has, into tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from harborlight.operators.latest import keep_last
from harborlight.session import run_dir

Writer = Callable[[DataFrame, int], None]


def start(stream: DataFrame, base: str) -> StreamingQuery:
    """Start appending all rows of a stream to a Parquet table below ``base``."""
    return (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )


def table(stream: DataFrame, base: str) -> DataFrame:
    """What a stream has written below ``base``."""
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{base}/out")


def drain(stream: DataFrame, label: str, base: str | None = None) -> DataFrame:
    """Append all rows of a stream to a Parquet table and return that table."""
    base = base or run_dir(stream.sparkSession, label)
    start(stream, base).awaitTermination()
    return table(stream, base)


def each_batch(stream: DataFrame, write: Writer, base: str, mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch to a writer; the checkpoint moves on after it."""
    query = (
        stream.writeStream.outputMode(mode).foreachBatch(write)
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query


def drain_updates(stream: DataFrame, keys: Sequence[str], label: str, base: str | None = None) -> DataFrame:
    """Run an aggregation in update mode and return the last figures of each key.

    Every batch writes the rows it changed to a folder of its own, so a batch that is repeated changes nothing.
    """
    spark = stream.sparkSession
    base = base or run_dir(spark, label)

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")

    each_batch(stream, write, base, "update")
    changes = spark.read.schema(f"{_ddl(stream)}, batch_id int").parquet(f"{base}/out")
    return keep_last(changes, keys, ["batch_id"]).drop("batch_id")


def start_aggregate(sums: DataFrame, base: str) -> StreamingQuery:
    """Start an aggregation whose only result is its state, which ``state_rows`` reads."""
    return (
        sums.writeStream.outputMode("update").format("noop")
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )


def state_rows(spark: SparkSession, base: str, kind: str) -> DataFrame:
    """Keys and sums that an aggregation holds in its checkpointed state, as of its last batch.

    ``kind`` is the type of the sums: a field for each aggregate in order (two for a sum of decimals, the second
    tells whether nothing was summed). Windows behind the watermark have left the state.
    """
    rows = spark.read.format("statestore").load(f"{base}/state")
    return rows.select("key.*", F.col("value").cast(kind).alias("value")).select(
        *[f"`{c}`" for c in rows.select("key.*").columns], "value.*")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
