"""Incremental and merge queries: a table as of a date, then a later batch."""

from pyspark.sql import functions as F

from harborlight.operators import merge as ops
from harborlight.operators import orders as ord_ops
from harborlight.operators import suppliers as sup
from harborlight.operators.orders import ARRIVAL_ORDER
from harborlight.oracle import TABLES
from harborlight.registry import query
from harborlight.sources.derived import ORDER_COLUMNS

COLS = ", ".join(ORDER_COLUMNS)
CUT = "1999-01-01"

LAST = ("row_number() OVER (PARTITION BY order_id ORDER BY expected_delivery DESC, _k1 DESC, _k2 DESC, order_value DESC) = 1")
VALID = "order_id IS NOT NULL AND trim(order_id) <> '' AND coalesce(delay_days, 0) BETWEEN 0 AND 365"
# the table as of the cut, and the rows that came later (ids repeat, also across the cut)
TABLES["old_orders"] = f"""
SELECT * REPLACE (coalesce(delay_days, 0) AS delay_days) FROM raw_orders
WHERE {VALID} AND expected_delivery < TIMESTAMP '{CUT}' QUALIFY {LAST}"""
TABLES["late_orders"] = f"""
SELECT * REPLACE (coalesce(delay_days, 0) AS delay_days) FROM raw_orders
WHERE {VALID} AND expected_delivery >= TIMESTAMP '{CUT}'"""
TABLES["late_last"] = f"SELECT * FROM late_orders QUALIFY {LAST}"


def cut():
    return F.lit(CUT).cast("timestamp_ntz")


def valid_rows(t):
    raw = t.bronze_orders()
    return raw.filter(F.trim("order_id") != "").withColumn(
        "delay_days", F.coalesce("delay_days", F.lit(0))).filter(F.col("delay_days").between(0, 365))


def old_orders(t):
    return ord_ops.silver_orders(t.bronze_orders().filter(F.col("expected_delivery") < cut()))


def late_orders(t):
    return valid_rows(t).filter(F.col("expected_delivery") >= cut())


@query("upsert_keep_last", "A14 N03", f"""
SELECT {COLS} FROM old_orders WHERE order_id NOT IN (SELECT order_id FROM late_orders)
UNION ALL SELECT {COLS} FROM late_last""")
def upsert_keep_last(t):
    return ops.upsert(old_orders(t), late_orders(t), ["order_id"], ARRIVAL_ORDER).select(*ORDER_COLUMNS)


@query("upsert_partial", "A15", """
SELECT coalesce(o.order_id, n.order_id) AS order_id,
       CASE WHEN o.order_id IS NULL THEN n.supplier_id ELSE o.supplier_id END AS supplier_id,
       CASE WHEN o.order_id IS NULL THEN n.order_value ELSE o.order_value END AS order_value,
       CASE WHEN o.order_id IS NULL THEN n.created_at ELSE o.created_at END AS created_at,
       CASE WHEN n.order_id IS NULL THEN o.status ELSE n.status END AS status,
       CASE WHEN n.order_id IS NULL THEN o.delay_days ELSE n.delay_days END AS delay_days,
       CASE WHEN n.order_id IS NULL THEN o.actual_delivery ELSE n.actual_delivery END AS actual_delivery,
       CASE WHEN n.order_id IS NULL THEN o.inventory_level ELSE n.inventory_level END AS inventory_level
FROM old_orders o FULL JOIN late_last n ON n.order_id = o.order_id""")
def upsert_partial(t):
    update = ["status", "delay_days", "actual_delivery", "inventory_level"]
    merged = ops.upsert_columns(old_orders(t), late_orders(t), "order_id", update, ARRIVAL_ORDER)
    return merged.select("order_id", "supplier_id", "order_value", "created_at", *update)


@query("insert_absent", "A16 D14", """
SELECT order_id, supplier_id, order_value, status FROM late_last WHERE order_id NOT IN (SELECT order_id FROM old_orders)""")
def insert_absent(t):
    return ops.insert_absent(old_orders(t), late_orders(t), ["order_id"], ARRIVAL_ORDER).select(
        "order_id", "supplier_id", "order_value", "status")


@query("supplier_stubs", "A17", """
SELECT supplier_id, supplier_id AS name, region, 1.0::DOUBLE AS trust_score, 0::BIGINT AS total_orders,
       0::BIGINT AS delayed_orders, 0.0::DOUBLE AS avg_delay_days
FROM order_events WHERE supplier_id NOT IN ('SUP-0', 'SUP-5', 'SUP-10', 'SUP-15', 'SUP-20')
QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY event_time DESC, event_id DESC) = 1""")
def supplier_stubs(t):
    """Suppliers of incoming order events; every fifth number is known already."""
    from harborlight.streaming.validation import valid

    events = valid(t.stream_events().filter(F.col("event_type") == "ORDER"))
    known = t.base("events").select(
        F.concat(F.lit("SUP-"), ((F.col("user_id") * 5) % 25).cast("string")).alias("supplier_id")).distinct()
    return ops.supplier_stubs(events, known, ["event_time", "event_id"])


@query("fct_incremental", "N01", f"""
SELECT {COLS}, calculated_delay_days FROM fct_shipments
WHERE created_at <= TIMESTAMP '{CUT}' AND order_id NOT IN (
   SELECT order_id FROM fct_shipments WHERE created_at > (SELECT max(created_at) FROM fct_shipments WHERE created_at <= TIMESTAMP '{CUT}'))
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC, expected_delivery DESC, order_value DESC, supplier_id DESC, product DESC) = 1
UNION ALL
SELECT {COLS}, calculated_delay_days FROM fct_shipments
WHERE created_at > (SELECT max(created_at) FROM fct_shipments WHERE created_at <= TIMESTAMP '{CUT}')
QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY created_at DESC, expected_delivery DESC, order_value DESC, supplier_id DESC, product DESC) = 1""")
def fct_incremental(t):
    """The fact table up to the cut, then only rows after its newest one."""
    order = ["created_at", "expected_delivery", "order_value", "supplier_id", "product"]
    facts = ord_ops.shipments(t.staged_orders())
    target = ops.keep_last(facts.filter(F.col("created_at") <= cut()), ["order_id"], order)
    fresh = ops.newer_than(facts, t.base("orders").filter(F.col("o_orderdate") <= cut()).select(
        F.col("o_orderdate").alias("created_at")), "created_at")
    return ops.upsert(target, fresh, ["order_id"], order)


@query("dim_incremental", "N02 H01", f"""
SELECT s.supplier_id, s.region, s.trust_score, coalesce(n, 0) AS order_count,
       CASE WHEN m.supplier_id IS NULL THEN NULL ELSE s.total_orders END AS total_orders
FROM stg_suppliers s LEFT JOIN (SELECT supplier_id, count(order_id) AS n FROM stg_orders GROUP BY 1) o ON o.supplier_id = s.supplier_id
LEFT JOIN (SELECT DISTINCT supplier_id FROM silver_orders WHERE created_at >= TIMESTAMP '2001-06-01') m ON m.supplier_id = s.supplier_id""")
def dim_incremental(t):
    """Suppliers with recent orders are rebuilt; the rebuilt rows carry a new column."""
    full = sup.supplier_dimension(
        sup.staged_suppliers(t.suppliers()),
        ord_ops.staged_orders(t.bronze_orders("order_id", "supplier_id", "delay_days", "status")))
    recent = t.silver_orders().filter(
        F.col("created_at") >= F.lit("2001-06-01").cast("timestamp_ntz")).select("supplier_id").distinct()
    old = full.select("supplier_id", "region", "trust_score", "order_count")
    rebuilt = full.join(recent, "supplier_id", "left_semi").select(
        "supplier_id", "region", "trust_score", "order_count", "total_orders")
    return ops.upsert(old, rebuilt, ["supplier_id"], ["supplier_id"])


@query("union_evolve", "H01", """
SELECT order_id, status, NULL AS carrier FROM silver_orders WHERE status <> 'DELAYED'
UNION ALL SELECT order_id, status, 'C' || quantity FROM silver_orders WHERE status = 'DELAYED'""")
def union_evolve(t):
    silver = t.silver_orders()
    old = silver.filter(F.col("status") != "DELAYED").select("order_id", "status")
    new = silver.filter(F.col("status") == "DELAYED").select(
        "order_id", "status", F.concat(F.lit("C"), F.col("quantity").cast("string")).alias("carrier"))
    return old.unionByName(new, allowMissingColumns=True)


@query("dlq_split", "A18", f"""
SELECT event_id, errors AS error, event_type || '/' || order_id AS context FROM validated_events WHERE errors <> ''""")
def dlq_split(t):
    from harborlight.streaming.validation import dead_letters, with_errors

    return dead_letters(with_errors(t.stream_events()), t.event_anchor()).select("event_id", "error", "context")


def _layer(layer, source, observed=True, delayed="NULL::BIGINT", critical="NULL::BIGINT"):
    """Rows of a layer, and what was seen of it while it was written."""
    return (f"SELECT '{layer}' AS layer, count(*) AS rows, {'count(*)' if observed else 'NULL::BIGINT'} AS observed, "
            f"{delayed} AS delayed, {critical} AS high_critical FROM {source}")


@query("medallion_run", "N03 A11 A12 A13 N05 J04 K04 E05", " UNION ALL ".join([
    _layer("bronze/orders", "raw_orders", False),
    _layer("silver/orders", "silver_orders", False),
    _layer("silver/freight_rates", "freight_silver"),
    _layer("silver/wh_capacities", "wh_silver"),
    _layer("silver/plant_ports", "plant_ports"),
    _layer("silver/products", "products_per_plant"),
    _layer("quality/orders", "range(3)"),
    _layer("models/stg_orders", "stg_orders"),
    _layer("models/stg_suppliers", "stg_suppliers"),
    _layer("models/fct_shipments", "fct_shipments"),
    _layer("models/dim_suppliers", "stg_suppliers"),
    _layer("models/agg_control_tower", "range(1)"),
    _layer("gold/orders_ai_ready", "silver_orders", True, "count(*) FILTER (WHERE delay_days > 0)", "count(*) FILTER (WHERE delay_days > 7)"),
    _layer("gold/deviations", "silver_orders WHERE delay_days > 0"),
    _layer("gold/supplier_risk", "supplier_risk"),
    _layer("gold/forecasted_risks", "all_risks"),
    _layer("gold/demand_forecast", "range(30)"),
]))
def medallion_run(t):
    """The batch job over two loads, the older orders first; the later load is run twice, as after a failure.

    ``observed`` and the figures behind it come from the last write of a layer; bronze and silver observe the load only.
    """
    from harborlight.medallion import LAYERS, Feeds, Medallion
    from harborlight.session import run_dir

    job = Medallion(t.spark, run_dir(t.spark, "medallion"), t.order_anchor())
    bronze = t.bronze_orders()
    day = F.date_trunc("YEAR", F.col("created_at"))
    feeds = Feeds(t.freight_rates(), t.wh_capacities(), t.plant_ports(), t.products_per_plant(), t.suppliers())
    older, later = bronze.filter(F.col("expected_delivery") < cut()), bronze.filter(F.col("expected_delivery") >= cut())
    for load_id, load in (("1", older), ("2", later), ("2", later)):
        job.run(load, feeds, day, load_id)
    job.maintain()
    out = None
    for layer in LAYERS:
        seen = {} if layer in ("bronze/orders", "silver/orders") else job.metrics[layer]
        figures = [F.lit(seen.get(c)).cast("long").alias(name) for c, name in (
            ("rows", "observed"), ("delayed", "delayed"), ("high_critical", "high_critical"))]
        rows = job.read(layer).agg(F.count("*").alias("rows")).select(F.lit(layer).alias("layer"), "rows", *figures)
        out = rows if out is None else out.unionByName(rows)
    return out
