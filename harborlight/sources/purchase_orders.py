"""Nested purchase orders and stock movements to flat rows and order events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.functions.numeric import clamp, round_to

PURCHASE_ORDER = """
  id string, orderNumber string, identifier string, status string, estimatedDeliveryDate string,
  dateReceived string, daysLate int, currentStockLevel double, sourceSystem string,
  origin struct<id: string, name: string>, destination struct<id: string, name: string>,
  orderItems array<struct<id: string, product: struct<id: string, productCode: string, name: string>,
    quantity: int, unitPrice: double, totalPrice: double>>
"""
STOCK_MOVEMENT = """
  id string, identifier string, status string, dateCreated string,
  origin struct<id: string, name: string>, destination struct<id: string, name: string>,
  lineItems array<struct<id: string, product: struct<id: string, productCode: string, name: string>,
    quantityRequested: int>>
"""


def parse(lines: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """JSON lines to nested rows, other columns kept."""
    others = [c for c in lines.columns if c != value]
    # inline keeps later filters above the parsing, which so runs once per line
    return lines.select(*others, F.inline(F.array(F.from_json(value, schema))))


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def flatten(po: DataFrame) -> DataFrame:
    """Supplier, place and first item next to the other fields.

    A missing supplier or place gives empty text, an order without items nulls.
    """
    plain = [c for c in po.columns if c not in ("origin", "destination", "orderItems")]
    item = F.get("orderItems", F.lit(0))
    has_item = item.isNotNull()

    def of_item(value: Column, default) -> Column:
        return F.when(has_item, F.coalesce(value, F.lit(default)))

    return po.select(
        *plain,
        _or_empty("origin.id").alias("originId"),
        _or_empty("origin.name").alias("originName"),
        _or_empty("destination.name").alias("destinationName"),
        of_item(item["product"]["productCode"], "").alias("productCode"),
        of_item(item["product"]["name"], "").alias("productName"),
        of_item(item["quantity"], 1).alias("quantityOrdered"),
        of_item(item["unitPrice"], 0.0).alias("unitPrice"),
        of_item(item["totalPrice"], 0.0).alias("totalPrice"),
    )


def flatten_movements(moves: DataFrame) -> DataFrame:
    plain = [c for c in moves.columns if c not in ("origin", "destination", "lineItems")]
    item = F.get("lineItems", F.lit(0))
    return moves.select(
        *plain,
        _or_empty("origin.name").alias("originName"),
        _or_empty("destination.name").alias("destinationName"),
        F.when(item.isNotNull(), F.coalesce(item["product"]["productCode"], F.lit(""))).alias("productCode"),
        F.when(item.isNotNull(), F.coalesce(item["quantityRequested"], F.lit(1))).alias("quantityOrdered"),
    )


def _first_of(*columns: Column) -> Column:
    """The first text that is not null or empty, else the last one as it is."""
    named = [F.nullif(c, F.lit("")) for c in columns[:-1]]
    return F.coalesce(*named, columns[-1])


def order_events(flat: DataFrame, today: Column) -> DataFrame:
    """Flat purchase orders to order events; rows without supplier or product go."""
    quantity = F.coalesce("quantityOrdered", F.lit(1))
    price = F.coalesce("unitPrice", F.lit(0.0))
    total = F.coalesce(F.nullif("totalPrice", F.lit(0.0)), price * quantity)
    delay = F.coalesce("daysLate", F.lit(0))
    product = F.coalesce(_first_of(F.col("productCode"), F.col("productName")), F.lit("UNKNOWN"))
    supplier = F.coalesce(_first_of(F.col("originId"), F.col("originName")), F.lit("UNKNOWN"))
    place = _first_of(F.col("destinationName"), F.lit("UNKNOWN"))
    region = rules.region_prefix(place)
    rows = flat.withColumn("_product", product).withColumn("_supplier", supplier).filter(
        (F.col("_product") != "") & (F.col("_supplier") != ""))
    return rows.select(
        _first_of(F.col("orderNumber"), F.col("identifier"), F.concat(F.lit("OB-"), "id")).alias("order_id"),
        F.col("_supplier").alias("supplier_id"),
        F.col("_product").alias("product"),
        _first_of(region, F.lit("UNKNOWN")).alias("region"),
        F.greatest(F.lit(1), quantity).alias("quantity"),
        round_to(price, 2).alias("unit_price"),
        round_to(total, 2).alias("order_value"),
        _first_of(F.col("estimatedDeliveryDate"), today).alias("expected_delivery"),
        F.col("dateReceived").alias("actual_delivery"),
        F.greatest(F.lit(0), delay).alias("delay_days"),
        rules.canonical_status(F.col("status"), delay).alias("status"),
        clamp(F.coalesce("currentStockLevel", F.lit(50.0)), 0.0, 100.0).alias("inventory_level"),
        F.lit("ORDER").alias("event_type"),
        rules.health_bucket(delay).alias("supplier_health"),
        F.concat(F.lit("OPENBOXES_IMPORT (source="), F.coalesce("sourceSystem", F.lit("OPENBOXES")), F.lit(")"))
        .alias("causality_chain"),
    )
