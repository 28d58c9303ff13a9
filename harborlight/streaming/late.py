"""A ledger of rows that came behind the watermark, which Spark drops and only counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from harborlight.session import path_exists
from harborlight.streaming.running import _ddl, each_batch
from harborlight.streaming.windows import RETENTION, WINDOW

MARKS = "batch_id long, newest timestamp"


def record(events: DataFrame, base: str, horizon: str = RETENTION, window: str = WINDOW) -> DataFrame:
    """All rows that the stream has brought so far, with ``late``; each is written once.

    Late are rows of windows that had ended ``horizon`` before the newest event of the batches before theirs: the watermark that
    an aggregate over the same stream goes by. A batch that is repeated replaces its own rows; of earlier batches only the
    newest time is read, one number for each.
    """
    spark = events.sparkSession
    rows, marks = f"{base}/rows", f"{base}/marks"

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = None
        if batch_id and path_exists(spark, marks):
            newest = spark.read.schema(MARKS).parquet(marks).filter(F.col("batch_id") < batch_id).agg(F.max("newest")).first()[0]
        late = F.lit(False)
        if newest is not None:
            # the watermark has whole milliseconds
            mark = F.date_trunc("MILLISECOND", F.lit(newest)) - F.expr(f"INTERVAL {horizon}")
            late = F.window("event_time", window)["end"] <= mark
        seen = Observation(f"late-{batch_id}")
        batch.withColumn("late", late).observe(seen, F.max("event_time").alias("newest")).write.mode("overwrite").parquet(
            f"{rows}/batch_id={batch_id}")
        spark.createDataFrame([(batch_id, seen.get["newest"])], MARKS).coalesce(1).write.mode("overwrite").parquet(
            f"{marks}/batch={batch_id}")

    each_batch(events, write, base)
    return spark.read.schema(f"{_ddl(events)}, late boolean, batch_id int").parquet(rows)
