"""Order queries: cleaning, staging, facts, listings."""

from pyspark.sql import functions as F

from harborlight.functions import numeric, rules
from harborlight.operators import deviations as dev
from harborlight.operators import orders as ops
from harborlight.operators.suppliers import supplier_risk
from harborlight.oracle import ORDER_STATUS, rnd
from harborlight.registry import query
from harborlight.sources.derived import ORDER_COLUMNS

COLS = ", ".join(ORDER_COLUMNS)


@query("silver_orders", "C02 F01 N03", f"SELECT {COLS} FROM silver_orders")
def silver_orders(t):
    """Straight from the raw rows, without the layer tables in between."""
    return ops.silver_orders(t.raw_orders()).select(*ORDER_COLUMNS)


@query("cleaned_orders", "C01", f"""
SELECT {COLS} FROM raw_orders
WHERE order_id IS NOT NULL AND order_id <> '' AND delay_days >= 0 AND delay_days <= 365 AND status IN {ORDER_STATUS}""")
def cleaned_orders(t):
    return ops.cleaned_orders(t.bronze_orders(*ORDER_COLUMNS))


@query("stg_orders", "B14", f"SELECT {COLS} FROM stg_orders")
def stg_orders(t):
    return t.staged_orders()


@query("fct_shipments", "C03", f"SELECT {COLS}, calculated_delay_days FROM fct_shipments")
def fct_shipments(t):
    return ops.shipments(t.staged_orders())


@query("calc_delay", "B16", """
SELECT calculated_delay_days, delay_days, count(*) AS n FROM fct_shipments GROUP BY 1, 2""")
def calc_delay(t):
    return (
        ops.shipments(t.staged_orders())
        .groupBy("calculated_delay_days", "delay_days")
        .agg(F.count("*").alias("n"))
    )


@query("open_orders", "C04", """
SELECT order_id, supplier_id, status, order_value, status NOT IN ('DELIVERED', 'CANCELLED') AS open_for_api
FROM silver_orders WHERE status <> 'DELIVERED'""")
def open_orders(t):
    return ops.open_orders(
        t.silver_orders().select("order_id", "supplier_id", "status", "order_value")
    )


@query("coerce_orders", "B02 B03", f"""
SELECT order_id, supplier_id, product, region, quantity, {rnd('price', 2)} AS unit_price,
       {rnd("CASE WHEN val = 0 AND price > 0 THEN price * quantity ELSE val END", 2)} AS order_value,
       expected_delivery, actual_delivery, delay_days,
       CASE WHEN st IN {ORDER_STATUS} THEN st ELSE 'PENDING' END AS status, inventory_level, created_at
FROM (
  SELECT order_id, coalesce(nullif(trim(supplier_id), ''), 'UNKNOWN') AS supplier_id,
         coalesce(product, 'UNKNOWN') AS product, coalesce(region, 'UNKNOWN') AS region,
         CASE WHEN _k1 % 7 = 0 THEN 1 ELSE greatest(1, quantity) END AS quantity,
         CASE WHEN _k1 % 11 = 0 THEN 0.0 ELSE unit_price END AS price,
         CASE WHEN _k1 % 5 = 0 THEN 0.0::DOUBLE
              WHEN _k1 % 6 = 0 THEN CASE WHEN _k1 % 11 = 0 THEN 0.0 ELSE unit_price END
                  * CASE WHEN _k1 % 7 = 0 THEN 1 ELSE greatest(1, quantity) END
              ELSE order_value END AS val,
         strftime(expected_delivery, '%Y-%m-%d') AS expected_delivery,
         strftime(actual_delivery, '%Y-%m-%d') AS actual_delivery,
         greatest(0, coalesce(delay_days, 0)) AS delay_days,
         upper(CASE WHEN _k1 % 13 = 0 THEN CASE WHEN delay_days > 0 THEN 'DELAYED' ELSE 'PENDING' END
                    ELSE status END) AS st,
         least(100.0, greatest(0.0, inventory_level * 1.5::DOUBLE - 10.0::DOUBLE)) AS inventory_level,
         CASE WHEN _k1 % 3 = 0 THEN strftime((SELECT now FROM anchor), '%Y-%m-%d')
              ELSE strftime(created_at, '%Y-%m-%d') END AS created_at
  FROM raw_orders WHERE order_id IS NOT NULL AND trim(order_id) <> '')""")
def coerce_orders(t):
    """Orders as a foreign loader would give them: text columns with gaps and junk."""
    k = F.col("_k1")

    def text(c):
        return F.col(c).cast("string")

    foreign = t.bronze_orders().select(
        F.concat(F.lit("  "), "order_id", F.lit(" ")).alias("order_id"),
        "supplier_id", "product", "region",
        F.when(k % 7 == 0, "many").otherwise(text("quantity")).alias("quantity"),
        F.when(k % 11 == 0, "n/a").otherwise(text("unit_price")).alias("unit_price"),
        F.when(k % 5 == 0, "0").when(k % 6 == 0, "?").otherwise(text("order_value")).alias("order_value"),
        text("delay_days").alias("delay_days"),
        F.when(k % 13 == 0, F.lit("")).otherwise(F.lower("status")).alias("status"),
        (F.col("inventory_level") * 1.5 - 10.0).cast("string").alias("inventory_level"),
        F.date_format("expected_delivery", "yyyy-MM-dd").alias("expected_delivery"),
        F.date_format("actual_delivery", "yyyy-MM-dd").alias("actual_delivery"),
        F.when(k % 3 != 0, F.date_format("created_at", "yyyy-MM-dd")).alias("created_at"),
    )
    return ops.coerce_orders(foreign, F.date_format(t.order_anchor(), "yyyy-MM-dd"))


@query("coerce_numeric", "B03", """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN -1.5::DOUBLE WHEN o_orderkey % 4 = 1 THEN -1.5::DOUBLE
       ELSE o_totalprice END AS as_double,
       CAST(CASE WHEN o_orderkey % 4 IN (0, 1) THEN 0 ELSE trunc(o_totalprice) END AS INTEGER) AS as_int
FROM orders""")
def coerce_numeric(t):
    key = F.col("o_orderkey")
    dirty = F.when(key % 4 == 0, "").when(key % 4 == 1, "n/a").otherwise(
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return t.base("orders").select(
        "o_orderkey",
        numeric.to_double(dirty, -1.5).alias("as_double"),
        numeric.to_int(dirty, 0).alias("as_int"),
    )


@query("parse_timestamps", "B04", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (5, 6) THEN NULL ELSE o_orderdate END AS parsed,
       CASE WHEN o_orderkey % 7 IN (5, 6) THEN (SELECT max(o_orderdate) FROM orders) ELSE o_orderdate END AS filled
FROM orders""")
def parse_timestamps(t):
    """Dates in five spellings and two kinds of junk."""
    d, key = F.col("o_orderdate"), F.col("o_orderkey") % 7
    text = (
        F.when(key == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(key == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(key == 2, F.concat(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
        .when(key == 3, F.date_format(d, "MM/dd/yyyy"))
        .when(key == 4, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(key == 5, "invalid-date")
        .otherwise("99/99/99")
    )
    newest = t.base("orders").agg(F.max("o_orderdate")).scalar()
    parsed = ops.parse_timestamp(text).cast("timestamp_ntz")
    return t.base("orders").select(
        "o_orderkey", parsed.alias("parsed"), F.coalesce(parsed, newest).alias("filled")
    )


@query("derive_unit_price", "B05", """
SELECT order_id, order_value / CASE WHEN quantity % 10 = 0 THEN 1 ELSE quantity END AS unit_price FROM silver_orders""")
def derive_unit_price(t):
    """Every tenth quantity is blanked to 0 to meet the zero rule."""
    q = F.when(F.col("quantity") % 10 == 0, 0).otherwise(F.col("quantity"))
    return t.silver_orders().select("order_id", ops.unit_price(F.col("order_value"), q).alias("unit_price"))


@query("serving_orders", "A19", """
SELECT order_id, supplier_id, product, region, coalesce(quantity, 1) AS quantity, order_value,
       order_value / CASE WHEN quantity = 0 THEN 1 ELSE quantity END AS unit_price,
       coalesce(delay_days, 0) AS delay_days, coalesce(status, 'UNKNOWN') AS status,
       coalesce(inventory_level, 0.0::DOUBLE) AS inventory_level,
       coalesce(expected_delivery, now) AS expected_delivery, now AS created_at
FROM silver_orders, anchor""")
def serving_orders(t):
    return ops.serving_orders(t.silver_orders(), t.order_anchor())


@query("serving_deviations", "A19", """
SELECT 'GOLD-' || order_id || '-' || CASE WHEN delay_days > 7 THEN 'DELAY' ELSE 'MINOR_DELAY' END AS deviation_id, order_id,
       CASE WHEN delay_days > 14 THEN 'CRITICAL' WHEN delay_days > 7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       CASE WHEN delay_days > 7 THEN 'DELAY' ELSE 'MINOR_DELAY' END AS type, now AS detected_at, false AS executed, now AS created_at
FROM silver_orders, anchor WHERE delay_days > 0""")
def serving_deviations(t):
    return ops.serving_deviations(dev.delay_only(t.silver_orders()), t.order_anchor())


@query("serving_suppliers", "A19", """
SELECT supplier_id, supplier_id AS name, 'NA' AS region, trust_score, total_orders, delayed_orders, avg_delay_days,
       now AS created_at, now AS updated_at FROM supplier_risk, anchor""")
def serving_suppliers(t):
    return ops.serving_suppliers(supplier_risk(t.silver_orders()), t.order_anchor())


@query("list_orders", "C05 G03", """
SELECT order_id, supplier_id, status, created_at FROM silver_orders
WHERE status = 'DELAYED' AND supplier_id = 'Supplier#000000003'
ORDER BY created_at DESC, order_id LIMIT 50 OFFSET 25""")
def list_orders(t):
    return ops.listing(
        t.silver_orders().select("order_id", "supplier_id", "status", "created_at"),
        [F.col("created_at").desc(), F.col("order_id").asc()], 50, 25,
        status="DELAYED", supplier_id="Supplier#000000003", region=None,
    )


@query("order_timeline", "F09", """
SELECT order_id, 'ORDER_PLACED' AS event, created_at AS at, 'Qty: ' || quantity || ', Product: ' || product AS detail
FROM silver_orders
UNION ALL SELECT order_id, 'IN_TRANSIT',
   created_at + to_seconds(date_diff('second', created_at, expected_delivery) / 10.0),
   'Shipment dispatched from supplier facility'
FROM silver_orders WHERE status IN ('DELIVERED', 'DELAYED', 'IN_TRANSIT')
UNION ALL SELECT order_id, 'DEVIATION_' || type, detected_at, 'Severity: ' || severity || ', ' || recommended_action
FROM deviations
UNION ALL SELECT order_id, 'EXPECTED_DELIVERY', expected_delivery,
   'Original SLA: ' || strftime(expected_delivery, '%b %d, %Y') FROM silver_orders
UNION ALL SELECT order_id, 'DELIVERED', actual_delivery, 'Delivered ' || strftime(actual_delivery, '%b %d, %Y')
   || CASE WHEN delay_days = 0 THEN ' (on time)' ELSE ' (' || delay_days || 'd late)' END
FROM silver_orders WHERE status = 'DELIVERED' AND actual_delivery IS NOT NULL
UNION ALL SELECT order_id, 'DELAY_CONFIRMED', expected_delivery, 'Delayed by ' || delay_days || ' days'
FROM silver_orders WHERE status = 'DELAYED'""")
def order_timeline(t):
    return ops.timeline(t.silver_orders(), t.deviations())


@query("deviations_v1", "K01", f"""
SELECT order_id, delay_days, inventory_level, order_value, deviation_type,
       CASE WHEN delay_days > 14 THEN 'CRITICAL' WHEN delay_days > 7 THEN 'HIGH'
            WHEN inventory_level < 5 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM (SELECT *, CASE WHEN delay_days > 7 THEN 'DELAY' WHEN inventory_level < 10 THEN 'STOCKOUT'
             WHEN order_value > 100000 THEN 'ANOMALY' END AS deviation_type
      FROM raw_orders WHERE order_id IS NOT NULL AND order_id <> '' AND delay_days BETWEEN 0 AND 365
        AND status IN {ORDER_STATUS})
WHERE deviation_type IS NOT NULL""")
def deviations_v1(t):
    cleaned = ops.cleaned_orders(
        t.bronze_orders("order_id", "delay_days", "inventory_level", "order_value", "status"))
    return dev.first_match(cleaned).drop("status")


@query("gold_deviations", "K02", """
SELECT order_id, delay_days, order_value, CASE WHEN delay_days > 7 THEN 'DELAY' ELSE 'MINOR_DELAY' END AS deviation_type,
       CASE WHEN delay_days > 14 THEN 'CRITICAL' WHEN delay_days > 7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       'GOLD-' || order_id || '-' || CASE WHEN delay_days > 7 THEN 'DELAY' ELSE 'MINOR_DELAY' END AS deviation_id
FROM silver_orders WHERE delay_days > 0""")
def gold_deviations(t):
    return dev.delay_only(t.silver_orders().select("order_id", "delay_days", "order_value"))


@query("deviations_v3", "H02 K03 B19", """
SELECT order_id, deviation_id, type, severity, recommended_action, detected_at, executed FROM deviations""")
def deviations_v3(t):
    return t.deviations()


@query("recommended_action", "B19", """
SELECT type, severity, length(recommended_action) AS chars, count(*) AS n FROM deviations GROUP BY 1, 2, 3""")
def recommended_action(t):
    return t.deviations().groupBy("type", "severity", F.length("recommended_action").alias("chars")).agg(
        F.count("*").alias("n")).withColumn("chars", F.col("chars").cast("long"))


@query("row_hash", "B24", """
SELECT order_id, sha256(coalesce(order_id, '') || '|' || coalesce(supplier_id, '') || '|' || delay_days || '|' || status) AS row_hash
FROM silver_orders""")
def row_hash(t):
    fields = ["order_id", "supplier_id", "delay_days", "status"]
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    return t.silver_orders().select("order_id", F.sha2(F.concat_ws("|", *text), 256).alias("row_hash"))


@query("health_bucket", "B10", """
SELECT order_id, CASE WHEN delay_days = 0 THEN 'NORMAL' WHEN delay_days < 7 THEN 'DEGRADING' ELSE 'CRITICAL' END AS supplier_health
FROM silver_orders""")
def health_bucket(t):
    return t.silver_orders().select(
        "order_id", rules.health_bucket(F.col("delay_days")).alias("supplier_health"))


@query("financial_impact", "B17", f"""
SELECT deviation_id, {rnd('carry + late + short', 2)} AS usd, {rnd('carry', 2)} AS carrying_cost,
       {rnd('late', 2)} AS delay_cost, {rnd('short', 2)} AS stockout_penalty
FROM (SELECT deviation_id,
        CASE WHEN delay_days > 0 THEN order_value * (delay_days::DOUBLE / 30.0::DOUBLE) * 0.02::DOUBLE ELSE 0.0 END AS carry,
        delay_days * 500.0::DOUBLE AS late,
        CASE WHEN type = 'STOCKOUT' THEN order_value * 0.15::DOUBLE ELSE 0.0 END AS short FROM deviations)""")
def financial_impact(t):
    value, delay = F.col("order_value"), F.col("delay_days").cast("double")
    carry, late = rules.carrying_cost(value, delay), rules.delay_cost(delay)
    short = rules.stockout_penalty(value, F.col("type"))
    return t.deviations("order_value", "delay_days").select(
        "deviation_id",
        numeric.round_to(carry + late + short, 2).alias("usd"),
        numeric.round_to(carry, 2).alias("carrying_cost"),
        numeric.round_to(late, 2).alias("delay_cost"),
        numeric.round_to(short, 2).alias("stockout_penalty"),
    )
