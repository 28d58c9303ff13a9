"""Deviation rules. Three rule sets exist side by side and are kept by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.operators import asof


def first_match(orders: DataFrame) -> DataFrame:
    """Rule set 1: one row per order, the first rule that holds names it."""
    kind = (
        F.when(F.col("delay_days") > 7, "DELAY")
        .when(F.col("inventory_level") < 10, "STOCKOUT")
        .when(F.col("order_value") > 100000, "ANOMALY")
    )
    severity = (
        F.when(F.col("delay_days") > 14, "CRITICAL")
        .when(F.col("delay_days") > 7, "HIGH")
        .when(F.col("inventory_level") < 5, "HIGH")
        .when(F.col("deviation_type").isNotNull(), "MEDIUM")
    )
    return (
        orders.withColumn("deviation_type", kind)
        .withColumn("severity", severity)
        .filter(F.col("deviation_type").isNotNull())
    )


def with_delay_flags(orders: DataFrame) -> DataFrame:
    """Rule set 2: delays only; every order keeps its row."""
    delay = F.col("delay_days")
    return orders.withColumn(
        "deviation_type", F.when(delay > 7, "DELAY").when(delay > 0, "MINOR_DELAY")
    ).withColumn("severity", rules.delay_severity(delay))


def delay_only(orders: DataFrame) -> DataFrame:
    """Rows of rule set 2 that deviate, keyed by order and type so re-runs agree."""
    return with_delay_flags(orders).filter(F.col("deviation_type").isNotNull()).withColumn(
        "deviation_id", F.concat_ws("-", F.lit("GOLD"), F.col("order_id"), F.col("deviation_type"))
    )


def _finding(kind: str, severity: Column, action: Column) -> Column:
    return F.when(
        severity.isNotNull(),
        F.struct(F.lit(kind).alias("type"), severity.alias("severity"),
                 action.alias("recommended_action")),
    )


def findings() -> Column:
    """Rule set 3 as an array: delay, stock-out and value findings of one order."""
    delay, stock, value = F.col("delay_days"), F.col("inventory_level"), F.col("order_value")
    all_three = F.array(
        _finding("DELAY", rules.delay_severity(delay),
                 rules.delay_action_text(F.col("supplier_id"), delay)),
        _finding("STOCKOUT", F.when(stock < 5, "HIGH").when(stock < 10, "MEDIUM"),
                 rules.restock_action_text(F.col("product"), stock)),
        _finding("ANOMALY", F.when(value > 100000, F.lit("MEDIUM")),
                 rules.anomaly_action_text(value, F.col("supplier_id"))),
    )
    return F.filter(all_three, lambda x: x.isNotNull())


def all_matches(orders: DataFrame, *keep: str) -> DataFrame:
    """Rule set 3: nought to three rows per order from a single scan."""
    return orders.select("order_id", *keep, F.inline(findings())).withColumn(
        "deviation_id", F.concat_ws("-", F.lit("DEV"), F.col("order_id"), F.col("type"))
    )


def preemptive_stockouts(demand: DataFrame) -> DataFrame:
    """Demand signals of 25 % or more that meet less than a week of cover."""
    delta, cover = F.col("forecast_delta_pct"), F.col("current_inventory_days")
    return demand.filter((delta >= 25) & (cover < 7)).withColumn(
        "severity", F.when(delta >= 40, "HIGH").otherwise("MEDIUM")
    ).withColumn("type", F.lit("STOCKOUT")).withColumn(
        "demand_key", F.concat_ws("-", F.lit("DEMAND"), F.col("region"), F.substring("product", 1, 8))
    )


def anchor_to_orders(signals: DataFrame, orders: DataFrame) -> DataFrame:
    """Attach each signal to the newest open order of its product and region.

    The newest order per pair is found with a map-side combining aggregate, so
    the join meets at most one order row per pair. Signals without one drop out.
    """
    newest = (
        orders.filter(~F.col("status").isin(rules.CLOSED_STATUSES))
        .groupBy("product", "region")
        .agg(F.max(F.struct("created_at", "order_id")).alias("_newest"))
        .select("product", "region", F.col("_newest.order_id").alias("order_id"))
    )
    return signals.join(newest, ["product", "region"])


def anchor_as_of(signals: DataFrame, orders: DataFrame, at: Column) -> DataFrame:
    """Attach each signal to the newest open order of its product and region that is not after it.

    Signals without one drop out. Of orders made at one time the largest id counts.
    """
    still_open = orders.filter(~F.col("status").isin(rules.CLOSED_STATUSES))
    found = asof.latest_before(
        signals, still_open, ["product", "region"], at.cast("timestamp"), F.col("created_at").cast("timestamp"),
        F.col("order_id"), F.col("order_id"), "order_id")
    return found.filter(F.col("order_id").isNotNull())
