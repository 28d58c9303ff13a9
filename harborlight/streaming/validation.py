"""Rules for incoming events, as one array column of the fields that break them.

Works alike on a table and on a stream. Event types without rules pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborlight.functions.rules import ORDER_STATUSES

# Fields an event must have, by type.
ORDER_REQUIRED = [
    "order_id", "supplier_id", "product", "region", "quantity", "unit_price", "order_value",
    "expected_delivery", "delay_days", "status", "inventory_level",
]
DEMAND_REQUIRED = ["event_type", "product", "region", "forecast_delta_pct"]

EVENT_SCHEMA = T.StructType([
    T.StructField("event_type", T.StringType()),
    T.StructField("event_id", T.LongType()),
    T.StructField("event_time", T.TimestampType()),
    T.StructField("order_id", T.StringType()),
    T.StructField("supplier_id", T.StringType()),
    T.StructField("product", T.StringType()),
    T.StructField("region", T.StringType()),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("order_value", T.DoubleType()),
    T.StructField("expected_delivery", T.StringType()),
    T.StructField("delay_days", T.IntegerType()),
    T.StructField("status", T.StringType()),
    T.StructField("inventory_level", T.DoubleType()),
    T.StructField("forecast_delta_pct", T.DoubleType()),
    T.StructField("current_inventory_days", T.DoubleType()),
])


def _broken(name: str, condition: Column) -> Column:
    return F.when(condition, F.lit(name))


def error_list(columns: list[str], kind: Column) -> Column:
    """Names of the broken fields; an empty array means the event is fine."""
    order, demand = kind == "ORDER", kind == "DEMAND_SPIKE"
    checks = []

    def add(name: str, scope: Column, condition: Column) -> None:
        if name in columns:
            checks.append(_broken(name, scope & condition))

    def missing(name: str) -> Column:
        return F.col(name).isNull()

    def empty(name: str) -> Column:
        return missing(name) | (F.length(name) == 0)

    def below(name: str, low: float) -> Column:
        return missing(name) | (F.col(name) < low)

    add("order_id", order, empty("order_id"))
    add("supplier_id", order, empty("supplier_id"))
    add("product", order, missing("product"))
    add("region", order, missing("region"))
    add("quantity", order, below("quantity", 1))
    add("unit_price", order, below("unit_price", 0))
    add("order_value", order, below("order_value", 0))
    add("expected_delivery", order, missing("expected_delivery"))
    add("delay_days", order, below("delay_days", 0))
    add("status", order, missing("status") | ~F.col("status").isin(ORDER_STATUSES))
    add("inventory_level", order,
        missing("inventory_level") | ~F.col("inventory_level").between(0, 100))
    add("product", demand, empty("product"))
    add("region", demand, empty("region"))
    add("forecast_delta_pct", demand, missing("forecast_delta_pct"))
    add("current_inventory_days", demand, F.col("current_inventory_days") < 0)
    return F.array_compact(F.array(*checks))


def with_errors(events: DataFrame) -> DataFrame:
    """Events with the array of broken fields; a missing type counts as ORDER."""
    kind = F.coalesce(F.col("event_type"), F.lit("ORDER"))
    return events.withColumn("errors", error_list(events.columns, kind))


def valid(events: DataFrame) -> DataFrame:
    return with_errors(events).filter(F.size("errors") == 0).drop("errors")


def parse_json(messages: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to typed events; text that is no JSON leaves every field null."""
    parsed = F.from_json(F.col(value).cast("string"), EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    # inline keeps later filters above the parsing, which so runs once per message
    return messages.select(*messages.columns, F.inline(F.array(parsed)))


def dead_letters(events_with_errors: DataFrame, failed_at: Column) -> DataFrame:
    """Rejected events in the shape of the dead-letter topic."""
    body = F.to_json(F.struct(*[
        c for c in events_with_errors.columns if c not in ("errors", "event_time")]))
    return events_with_errors.filter(F.size("errors") > 0).select(
        "event_id",
        body.alias("original_message"),
        F.concat_ws(",", "errors").alias("error"),
        F.concat_ws("/", "event_type", "order_id").alias("context"),
        failed_at.alias("failed_at"),
    )
