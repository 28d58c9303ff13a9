"""Supplier health over a table of events: the batch form of ``keyed.health``, for histories and backfills.

A busy supplier is never one task: its events are split into time slices, each slice is worked out by
itself, and the slices are chained over a few numbers per slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harborlight.operators.latest import keep_last
from harborlight.streaming.keyed import anomaly


def _sliced(events: DataFrame, unit: str) -> DataFrame:
    return events.withColumn("_slice", F.date_trunc(unit, F.col("event_time").cast("timestamp")))


def health_path(events: DataFrame, state: DataFrame | None = None, unit: str = "DAY") -> DataFrame:
    """Anomaly count and health of the supplier after each event.

    An anomaly adds one to the count, a clean event takes one off, not below 0.
    NORMAL turns DEGRADING at 2 and CRITICAL at 5; CRITICAL falls back to
    DEGRADING at 2 and DEGRADING to NORMAL at 0. So the count is a walk with a
    floor: its steps added up, less the lowest point so far. And the health is
    what the last of the counts 0, 2 or 5 and more stands for.

    ``state`` (supplier_id, anomaly_count, health) is where earlier events ended.
    """
    steps = _sliced(events, unit).withColumn("_step", F.when(anomaly(), 1).otherwise(-1))
    inside = Window.partitionBy("supplier_id", "_slice").orderBy("event_time", "event_id")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = steps.withColumn("_sum", F.sum("_step").over(so_far)).withColumn(
        "_low", F.min("_sum").over(so_far))

    # one row per supplier and slice: how far it moves, and how low it gets on the way
    slices = local.groupBy("supplier_id", "_slice").agg(
        F.sum("_step").alias("_move"), F.min("_sum").alias("_slice_low"))
    by_supplier = Window.partitionBy("supplier_id").orderBy("_slice")
    earlier = by_supplier.rowsBetween(Window.unboundedPreceding, -1)
    if state is None:
        slices = slices.withColumn("_count0", F.lit(0)).withColumn("_health0", F.lit("NORMAL"))
    else:
        slices = slices.join(
            state.select("supplier_id", F.col("anomaly_count").alias("_count0"), F.col("health").alias("_health0")),
            "supplier_id", "left",
        ).fillna({"_count0": 0, "_health0": "NORMAL"})
    starts = (
        slices.withColumn("_at", F.coalesce(F.sum("_move").over(earlier), F.lit(0)))
        .withColumn("_floor", F.least(
            -F.col("_count0"), F.min(F.col("_at") + F.col("_slice_low")).over(earlier)))
        .select("supplier_id", "_slice", (F.col("_at") - F.col("_floor")).alias("_start"), "_health0")
    )
    counted = local.join(starts, ["supplier_id", "_slice"]).withColumn(
        "anomaly_count", F.col("_sum") - F.least(-F.col("_start"), F.col("_low")))
    c = F.col("anomaly_count")
    marked = counted.withColumn(
        "_mark", F.when(c == 0, "NORMAL").when(c == 2, "DEGRADING").when(c >= 5, "CRITICAL"))

    last_mark = marked.groupBy("supplier_id", "_slice").agg(
        F.max(F.when(F.col("_mark").isNotNull(), F.struct("event_time", "event_id", "_mark")))["_mark"]
        .alias("_slice_mark"))
    before = last_mark.withColumn(
        "_before", F.last("_slice_mark", ignorenulls=True).over(earlier)
    ).select("supplier_id", "_slice", "_before")
    return (
        marked.withColumn("_here", F.last("_mark", ignorenulls=True).over(so_far))
        .join(before, ["supplier_id", "_slice"])
        .select("event_id", "event_time", "supplier_id", c.cast("long").alias("anomaly_count"),
                F.coalesce("_here", "_before", "_health0").alias("health"))
    )


def health_state(path: DataFrame) -> DataFrame:
    """Where each supplier ended."""
    return keep_last(path, ["supplier_id"], ["event_time", "event_id"]).select(
        "supplier_id", "anomaly_count", "health")
