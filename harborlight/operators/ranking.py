"""Numbering a whole table without sending it through one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.session import checkpoint_root


def global_rank(df: DataFrame, order: Sequence[Column], name: str, start: int = 1) -> DataFrame:
    """Row number over the whole table in a total order.

    The table is range-partitioned by the order and checkpointed, which fixes
    which row lies in which range. Rows are numbered inside their range; the
    ranges' sizes, one number per range, give each range its first number.
    """
    checkpoint_root(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (
        df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    )
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))
    # one row per range: the only window without a key, over at most `parts` rows
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return (
        ranged.join(starts, "_range")
        .withColumn(name, (F.col("_start") + inside + (start - 1)).cast("long"))
        .drop("_range", "_start")
    )
