"""Purchase orders as nested JSON, made from line items and read back."""

from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.oracle import TABLES, rnd
from harborlight.plans.text import _MAP_SQL, sql_list
from harborlight.registry import query
from harborlight.sources import purchase_orders as po

_STATES = list(rules.EXTERNAL_STATUS)

# the fields a purchase order has, before nesting; some have no supplier, items, number or price
TABLES["po_rows"] = f"""
SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id,
  CASE WHEN l_partkey % 17 <> 0 THEN 'PO-' || l_orderkey END AS number,
  {sql_list(_STATES)}[CAST(l_partkey % {len(_STATES)} AS INTEGER) + 1] AS state,
  strftime(l_shipdate, '%Y-%m-%d') AS due, CAST(l_partkey % 12 - 1 AS INTEGER) AS late,
  CASE WHEN l_suppkey % 9 <> 0 THEN 'S-' || l_suppkey END AS supplier,
  CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE 'Site ' || l_suppkey % 5 || ' - Hall' END AS place,
  l_linenumber <> 7 AS has_item, 'P-' || l_partkey AS part, CAST(l_quantity AS INTEGER) AS qty,
  CASE WHEN l_partkey % 3 = 0 THEN 0.0::DOUBLE ELSE l_extendedprice END AS total,
  {rnd('l_extendedprice / l_quantity', 2)} AS price,
  CASE WHEN l_suppkey % 4 <> 0 THEN (l_partkey % 140)::DOUBLE END AS stock
FROM lineitem"""


def lines(t):
    """One JSON text per line item."""
    from harborlight.functions.numeric import round_to

    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    state = F.element_at(F.array(*[F.lit(s) for s in _STATES]), (part % len(_STATES) + 1).cast("int"))
    item = F.struct(
        F.struct(F.concat(F.lit("P-"), part.cast("string")).alias("productCode")).alias("product"),
        F.col("l_quantity").cast("int").alias("quantity"),
        round_to(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("unitPrice"),
        F.when(part % 3 == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("totalPrice"),
    )
    body = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.when(part % 17 != 0, F.concat(F.lit("PO-"), F.col("l_orderkey").cast("string"))).alias("orderNumber"),
        state.alias("status"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("estimatedDeliveryDate"),
        (part % 12 - 1).cast("int").alias("daysLate"),
        F.when(supp % 4 != 0, (part % 140).cast("double")).alias("currentStockLevel"),
        F.when(supp % 9 != 0, F.struct(
            F.concat(F.lit("S-"), supp.cast("string")).alias("id"),
            F.concat(F.lit("Supplier "), supp.cast("string")).alias("name"))).alias("origin"),
        F.when(part % 7 != 0, F.struct(
            F.concat(F.lit("Site "), (supp % 5).cast("string"), F.lit(" - Hall")).alias("name"))).alias("destination"),
        F.when(F.col("l_linenumber") != 7, F.array(item)).alias("orderItems"),
    )
    return t.base("lineitem").select(F.to_json(body).alias("value"))


def flat(t):
    """The JSON is written down as a feed would bring it, in as many files as there are cores to parse it."""
    cores = t.spark.sparkContext.defaultParallelism
    return po.flatten(po.parse(t.layer("purchase_orders", lambda: lines(t).repartition(cores)), po.PURCHASE_ORDER))


@query("purchase_orders_flat", "A07", """
SELECT id, number AS "orderNumber", state AS status, coalesce(supplier, '') AS "originId", coalesce(place, '') AS "destinationName",
       CASE WHEN has_item THEN part END AS "productCode", CASE WHEN has_item THEN qty END AS "quantityOrdered",
       CASE WHEN has_item THEN total END AS "totalPrice" FROM po_rows""")
def purchase_orders_flat(t):
    return flat(t).select("id", "orderNumber", "status", "originId", "destinationName", "productCode",
                          "quantityOrdered", "totalPrice")


@query("build_order_event", "B09 B08 B10 B11", f"""
SELECT coalesce(number, 'OB-' || id) AS order_id, supplier AS supplier_id,
       CASE WHEN has_item THEN part ELSE 'UNKNOWN' END AS product,
       coalesce(split_part(place, ' - ', 1), 'UNKNOWN') AS region,
       CASE WHEN has_item THEN greatest(1, qty) ELSE 1 END AS quantity,
       CASE WHEN has_item THEN price ELSE 0.0::DOUBLE END AS unit_price,
       CASE WHEN NOT has_item THEN 0.0::DOUBLE WHEN total <> 0 THEN {rnd('total', 2)} ELSE {rnd('price * qty', 2)} END AS order_value,
       due AS expected_delivery, greatest(0, late) AS delay_days,
       CASE WHEN late > 0 AND st <> 'CANCELLED' THEN 'DELAYED' ELSE st END AS status,
       least(100.0::DOUBLE, greatest(0.0::DOUBLE, coalesce(stock, 50.0::DOUBLE))) AS inventory_level,
       CASE WHEN late = 0 THEN 'NORMAL' WHEN late < 7 THEN 'DEGRADING' ELSE 'CRITICAL' END AS supplier_health,
       'OPENBOXES_IMPORT (source=OPENBOXES)' AS causality_chain
FROM (SELECT *, coalesce(CASE state {_MAP_SQL} END, 'PENDING') AS st FROM po_rows) WHERE supplier IS NOT NULL""")
def build_order_event(t):
    today = F.date_format(t.order_anchor(), "yyyy-MM-dd")
    return po.order_events(flat(t), today).drop("actual_delivery", "event_type")


@query("stock_movements_flat", "A07", """
SELECT id, coalesce(supplier, '') AS "originName", CASE WHEN has_item THEN part END AS "productCode",
       CASE WHEN has_item THEN qty END AS "quantityOrdered" FROM po_rows""")
def stock_movements_flat(t):
    body = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"),
        F.when(F.col("l_suppkey") % 9 != 0, F.struct(
            F.concat(F.lit("S-"), F.col("l_suppkey").cast("string")).alias("name"))).alias("origin"),
        F.when(F.col("l_linenumber") != 7, F.array(F.struct(
            F.struct(F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("productCode")).alias("product"),
            F.col("l_quantity").cast("int").alias("quantityRequested")))).alias("lineItems"),
    )
    moves = t.base("lineitem").select(F.to_json(body).alias("value"))
    return po.flatten_movements(po.parse(moves, po.STOCK_MOVEMENT)).select(
        "id", "originName", "productCode", "quantityOrdered")
