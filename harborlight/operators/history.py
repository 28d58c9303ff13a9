"""Event-sourced order history, state replay, audit chain, lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.operators.latest import keep_last


def with_previous(
    df: DataFrame, key: str, time: str, tie: str, values: Sequence[str], slice_unit: str = "DAY"
) -> DataFrame:
    """Row number and previous values per key, without one task per key.

    A window over the key alone would send all rows of a busy key to one task.
    Here rows are numbered inside (key, time slice). The slices of a key, a few
    numbers each, then tell every slice where its numbering starts and which
    row came last before it.
    """
    keyed = df.withColumn("_slice", F.date_trunc(slice_unit, F.col(time).cast("timestamp")))
    inside = Window.partitionBy(key, "_slice").orderBy(time, tie)
    local = keyed.withColumn("_n", F.row_number().over(inside))
    for v in values:
        local = local.withColumn(f"_lag_{v}", F.lag(v).over(inside))

    last = F.max(F.struct(time, tie, *values))
    slices = keyed.groupBy(key, "_slice").agg(F.count("*").alias("_size"), last.alias("_last"))
    by_key = Window.partitionBy(key).orderBy("_slice")
    starts = slices.select(
        key, "_slice",
        F.coalesce(F.sum("_size").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_start"),
        F.lag("_last").over(by_key).alias("_before"),
    )
    out = local.join(starts, [key, "_slice"])
    first = F.col("_n") == 1
    return out.select(
        *df.columns,
        (F.col("_start") + F.col("_n")).cast("long").alias("version"),
        *[F.when(first, F.col(f"_before.{v}")).otherwise(F.col(f"_lag_{v}")).alias(f"old_{v}") for v in values],
    )


def transition(first: Column, old_status: Column, status: Column, old_delay: Column, delay: Column) -> Column:
    """What a new state means against the one before it."""
    changed = ~old_status.eqNullSafe(status)
    return (
        F.when(first, "CREATED")
        .when(changed & status.isin("DELIVERED", "CANCELLED"), status)
        .when(changed, "STATUS_CHANGED")
        .when(~old_delay.eqNullSafe(delay), "DELAY_UPDATED")
        .otherwise("SNAPSHOT")
    )


def order_log(events: DataFrame, base_versions: DataFrame | None = None) -> DataFrame:
    """Order events with version, old state and kind of change.

    ``base_versions`` (order_id, version, status, delay_days) is the state an
    existing log ends with; new events go on from there.
    """
    log = with_previous(events, "order_id", "event_time", "event_id", ["status", "delay_days"])
    first = F.col("version") == 1
    if base_versions is not None:
        base = base_versions.select(
            "order_id", F.col("version").alias("_base"), F.col("status").alias("_status"),
            F.col("delay_days").alias("_delay"))
        log = log.join(base, "order_id", "left")
        head = first & F.col("_base").isNotNull()
        log = (
            log.withColumn("old_status", F.when(head, F.col("_status")).otherwise(F.col("old_status")))
            .withColumn("old_delay_days", F.when(head, F.col("_delay")).otherwise(F.col("old_delay_days")))
            .withColumn("version", F.col("version") + F.coalesce("_base", F.lit(0)))
        )
    kind = transition(F.col("version") == 1, F.col("old_status"), F.col("status"),
                      F.col("old_delay_days"), F.col("delay_days"))
    return log.select(
        "event_id", "event_time", "order_id", "supplier_id", "region",
        kind.alias("event_type"),
        "old_status", F.col("status").alias("new_status"),
        "old_delay_days", F.col("delay_days").alias("new_delay_days"),
        F.col("version").alias("aggregate_version"),
    )


def state_at(log: DataFrame, version: int) -> DataFrame:
    """State of each order at a version: the last known status and delay."""
    v = F.col("aggregate_version")

    def last_known(c: str) -> Column:
        return F.max(F.when(F.col(c).isNotNull(), F.struct(v, F.col(c))))

    return (
        log.filter(v <= version)
        .groupBy("order_id")
        .agg(last_known("new_status").alias("_s"), last_known("new_delay_days").alias("_d"),
             F.max(v).alias("version"))
        .select("order_id", F.col("_s.new_status").alias("status"),
                F.col("_d.new_delay_days").alias("delay_days"), "version")
    )


GENESIS = "0" * 64


def audit_findings(log: DataFrame) -> DataFrame:
    """Broken links and forks of a hash chain.

    Children are counted per hash first, so a hash that many rows claim as
    their predecessor reaches the join as one row.
    """
    children = log.groupBy("prev_hash").agg(
        F.count("*").alias("children"), F.min("id").alias("first_child"))
    owners = log.groupBy("row_hash").agg(F.min("id").alias("owner"))
    linked = children.join(owners, F.col("prev_hash") == F.col("row_hash"), "left")
    broken = (F.col("prev_hash") != GENESIS) & (
        F.col("owner").isNull() | (F.col("owner") >= F.col("first_child")))
    return linked.select(
        "prev_hash", "children", "first_child",
        F.coalesce(broken, F.lit(True)).alias("broken"),
        (F.col("children") > 1).alias("fork"),
    ).filter("broken OR fork")


def lineage_edges(runs: DataFrame) -> DataFrame:
    """Distinct input -> job and job -> output edges of completed runs."""
    inputs = F.coalesce(F.from_json("inputs", "array<string>"), F.array().cast("array<string>"))
    job = F.col("job_name")
    pairs = F.concat(
        F.transform(inputs, lambda i: F.struct(i.alias("source"), job.alias("target"))),
        F.when(F.col("output").isNotNull(), F.array(
            F.struct(job.alias("source"), F.col("output").alias("target")))).otherwise(
            F.array().cast("array<struct<source:string,target:string>>")),
    )
    return runs.filter(F.col("event_type") == "COMPLETE").select(F.inline(pairs)).distinct()


def lineage_nodes(runs: DataFrame) -> DataFrame:
    """Jobs and datasets the edges touch."""
    edges = lineage_edges(runs)
    ends = F.array(F.col("source"), F.col("target"))
    jobs = runs.select(F.col("job_name").alias("id"), F.lit("job").alias("_job")).distinct()
    return edges.select(F.explode(ends).alias("id")).distinct().join(jobs, "id", "left").select(
        "id", F.coalesce("_job", F.lit("dataset")).alias("type"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """Last status of every job."""
    return keep_last(runs, ["job_name"], ["created_at", "run_id"]).select(
        "job_name", F.col("event_type").alias("last_status"), F.col("created_at").alias("last_run"))
