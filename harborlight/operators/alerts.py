"""Figures over orders and deviations: control tower, trends, clusters, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.functions.numeric import count_if, money_sum, ratio, round_to


def control_tower(shipments: DataFrame) -> DataFrame:
    delay = F.col("calculated_delay_days")
    return shipments.agg(
        F.count("*").alias("total_shipments"),
        money_sum("order_value").alias("pipeline_value"),
        count_if(delay <= 0).alias("on_time_count"),
        count_if(delay > 0).alias("delayed_count"),
        count_if(delay > 7).alias("critical_delays"),
    ).withColumn(
        "on_time_pct", round_to(ratio(F.lit(100.0) * F.col("on_time_count"), F.col("total_shipments")), 2)
    )


def trend(deviations: DataFrame, today: Column, days: int) -> DataFrame:
    """Deviations per day and severity for the last days; empty days give zeros.

    Severities outside the three reported ones count as MEDIUM.
    """
    shown = ["CRITICAL", "HIGH", "MEDIUM"]
    age = F.datediff(today, F.col("detected_at"))
    counts = (
        deviations.filter((age >= 0) & (age < days))
        .select(F.to_date("detected_at").alias("day"),
                F.when(F.col("severity").isin(shown), F.col("severity")).otherwise("MEDIUM").alias("severity"))
        .groupBy("day").pivot("severity", shown).agg(F.count(F.lit(1)))
    )
    spark = deviations.sparkSession
    calendar = spark.range(days).select(F.date_sub(today.cast("date"), F.col("id").cast("int")).alias("day"))
    filled = [F.coalesce(F.col(s), F.lit(0)).alias(s) for s in shown]
    return calendar.join(counts, "day", "left").select(
        F.date_format("day", "yyyy-MM-dd").alias("date"), *filled,
    ).withColumn("total", F.col("CRITICAL") + F.col("HIGH") + F.col("MEDIUM"))


def clusters(deviations: DataFrame, since: Column, limit: int = 50) -> DataFrame:
    """Deviation counts by type and supplier, most frequent first."""
    return (
        deviations.filter(F.col("detected_at") >= since)
        .groupBy("type", "supplier_id")
        .agg(
            F.count("*").alias("count"),
            count_if(F.col("severity") == "CRITICAL").alias("critical_count"),
            F.max("detected_at").alias("last_seen"),
        )
        .orderBy(F.col("count").desc(), "type", "supplier_id")
        .limit(limit)
    )


def enriched(deviations: DataFrame, orders: DataFrame) -> DataFrame:
    """Deviations with the cost of their order; without an order the cost is 0."""
    value = F.coalesce("order_value", F.lit(0.0))
    delay = F.coalesce("delay_days", F.lit(0))
    return (
        deviations.join(
            orders.select("order_id", "supplier_id", "product", "region", "order_value", "delay_days"),
            "order_id", "left",
        )
        .withColumn("order_value", round_to(value, 2))
        .withColumn("cost_impact_usd", rules.alert_cost(value, delay))
        .withColumn("delay_days", delay)
        .withColumn("risk_tier", rules.cost_tier(F.col("cost_impact_usd")))
    )


def critical_since(deviations: DataFrame, orders: DataFrame, since: Column) -> DataFrame:
    """CRITICAL deviations per supplier from a moment on."""
    return (
        deviations.filter((F.col("severity") == "CRITICAL") & (F.col("detected_at") >= since))
        .select("order_id")
        .join(orders.select("order_id", "supplier_id"), "order_id")
        .groupBy("supplier_id")
        .agg(F.count("*").alias("recent_critical"))
    )


def rolling_critical(deviations: DataFrame, hours: int = 24) -> DataFrame:
    """CRITICAL deviations of the supplier in the hours up to each moment.

    Rows are first counted per supplier and moment. Each count then enters at
    its moment and leaves again when the hours are over, so a running sum of
    entries and exits is the answer; a sliding frame would add up its whole
    content again for every row. The sum runs inside day slices, and a slice
    starts with the total of those before it: a busy supplier is many tasks.
    """
    span = hours * 3600 * 1_000_000
    moments = (
        deviations.filter(F.col("severity") == "CRITICAL")
        .groupBy("supplier_id", "detected_at")
        .agg(F.count("*").alias("n"))
    )
    at = F.unix_micros(F.col("detected_at").cast("timestamp"))
    steps = moments.select(
        "supplier_id", "detected_at",
        F.inline(F.array(
            F.struct(at.alias("at"), F.col("n").alias("step"), F.lit(True).alias("enters")),
            F.struct((at + span + 1).alias("at"), (-F.col("n")).alias("step"), F.lit(False).alias("enters")),
        )),
    ).withColumn("_slice", F.floor(F.col("at") / 86_400_000_000))
    # at one moment exits come first
    inside = Window.partitionBy("supplier_id", "_slice").orderBy("at", "enters").rowsBetween(
        Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("supplier_id").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = steps.groupBy("supplier_id", "_slice").agg(F.sum("step").alias("_move")).select(
        "supplier_id", "_slice", F.coalesce(F.sum("_move").over(earlier), F.lit(0)).alias("_start"))
    return (
        steps.withColumn("_sum", F.sum("step").over(inside))
        .filter("enters")
        .join(starts, ["supplier_id", "_slice"])
        .select("supplier_id", "detected_at", (F.col("_start") + F.col("_sum")).alias("critical_24h"))
    )


def layer_metrics(layer: str, df: DataFrame, *measures: Column) -> DataFrame:
    """Run figures of one layer in one pass, one row per figure."""
    row = df.agg(*measures)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns
    ])
    return row.select(F.lit(layer).alias("layer"), F.inline(pairs))


def escalation_stats(escalations: DataFrame) -> DataFrame:
    done = (F.col("status") == "RESOLVED") & F.col("resolved_at").isNotNull()
    return escalations.agg(
        count_if(F.col("status") == "OPEN").alias("open_count"),
        count_if(F.col("status") == "RESOLVED").alias("resolved_count"),
        round_to(ratio(F.sum(F.when(done, seconds_between(F.col("created_at"), F.col("resolved_at")))),
                       count_if(done)) / 60, 1).alias("avg_resolve_minutes"),
    )


def seconds_between(start: Column, end: Column) -> Column:
    return F.unix_seconds(end.cast("timestamp")) - F.unix_seconds(start.cast("timestamp"))


def daily_spikes(rows: DataFrame, stamp: str, threshold: int = 10) -> DataFrame:
    """Rows per day against the day before. The window runs over days, not rows."""
    daily = rows.groupBy(F.to_date(stamp).alias("day")).agg(F.count("*").alias("total"))
    before = F.coalesce(F.lag("total").over(Window.orderBy("day")), F.lit(0))
    return daily.withColumn("new_messages", F.col("total") - before).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "new_messages",
        (F.col("new_messages") > threshold).alias("spike"),
    )


def mttr(actions: DataFrame, deviations: DataFrame, since: Column) -> DataFrame:
    """Minutes from detection to completion (recent) and to the action's creation (all time)."""
    done = actions.filter(F.col("status") == "COMPLETED").select(
        "deviation_id", "created_at", "completed_at", (F.col("completed_at") >= since).alias("_recent"))
    timed = done.join(deviations.select("deviation_id", "detected_at"), "deviation_id")
    resolve = seconds_between(F.col("detected_at"), F.col("completed_at"))
    respond = seconds_between(F.col("detected_at"), F.col("created_at"))
    recent = F.col("_recent")
    return timed.agg(
        count_if(recent).alias("total_completed"),
        round_to(F.coalesce(ratio(F.sum(F.when(recent, resolve)), count_if(recent)) / 60, F.lit(0.0)), 1)
        .alias("mttr_minutes"),
        round_to(F.coalesce(ratio(F.sum(respond), F.count("*")) / 60, F.lit(0.0)), 1).alias("response_minutes"),
    )
