"""Supplier queries: risk, dimension, control tower, costs, benchmarks, scorecards."""

from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.functions.numeric import count_if, round_to
from harborlight.operators import alerts
from harborlight.operators import suppliers as ops
from harborlight.operators import deviations as dev
from harborlight.operators import orders as ord_ops
from harborlight.oracle import money, rnd
from harborlight.registry import query


@query("supplier_risk", "E01", "SELECT * FROM supplier_risk")
def supplier_risk(t):
    """Straight from the raw rows: the whole path from scan to aggregate."""
    raw = t.raw_orders("order_id", "supplier_id", "delay_days", "expected_delivery",
                       "order_value", "_k1", "_k2")
    return ops.supplier_risk(ord_ops.silver_orders(raw))


@query("stg_suppliers", "B15", """
SELECT supplier_id, name, region, trust_score, CAST(total_orders AS BIGINT) AS total_orders,
       CAST(delayed_orders AS BIGINT) AS delayed_orders, avg_delay_days FROM stg_suppliers""")
def stg_suppliers(t):
    return ops.staged_suppliers(t.suppliers())


DIM_SQL = f"""
SELECT s.supplier_id, s.name, s.region, s.trust_score, s.total_orders, s.delayed_orders, s.avg_delay_days,
       coalesce(n, 0) AS order_count, coalesce(late, 0) AS delayed_count,
       CASE WHEN n > 0 THEN {rnd('100.0::DOUBLE * late / n', 2)} ELSE 0.0::DOUBLE END AS delay_rate_pct
FROM stg_suppliers s LEFT JOIN (
  SELECT supplier_id, count(order_id) AS n, count(*) FILTER (WHERE delay_days > 0) AS late
  FROM stg_orders GROUP BY 1) o ON o.supplier_id = s.supplier_id"""


def supplier_dimension(t):
    return ops.supplier_dimension(
        ops.staged_suppliers(t.suppliers()),
        ord_ops.staged_orders(t.bronze_orders("order_id", "supplier_id", "delay_days", "status")),
    )


@query("dim_suppliers", "D02 E04", DIM_SQL)
def dim_suppliers(t):
    return supplier_dimension(t)


@query("control_tower", "E03", f"""
SELECT count(*) AS total_shipments, {money('order_value')} AS pipeline_value,
       count(*) FILTER (WHERE calculated_delay_days <= 0) AS on_time_count,
       count(*) FILTER (WHERE calculated_delay_days > 0) AS delayed_count,
       count(*) FILTER (WHERE calculated_delay_days > 7) AS critical_delays,
       {rnd("100.0::DOUBLE * count(*) FILTER (WHERE calculated_delay_days <= 0) / nullif(count(*), 0)", 2)} AS on_time_pct,
       (SELECT now FROM anchor) AS refreshed_at
FROM fct_shipments""")
def control_tower(t):
    facts = ord_ops.shipments(ord_ops.staged_orders(t.bronze_orders(
        "order_id", "order_value", "expected_delivery", "actual_delivery", "delay_days", "status")))
    return alerts.control_tower(facts).withColumn("refreshed_at", t.order_anchor())


@query("ops_counters", "E23 E03", """
SELECT (SELECT count(*) FROM silver_orders) AS orders,
       (SELECT count(*) FROM silver_orders WHERE delay_days > 0) AS delayed_orders,
       (SELECT count(*) FROM deviations WHERE NOT executed) AS open_deviations,
       (SELECT count(*) FROM deviations WHERE severity = 'CRITICAL' AND NOT executed) AS critical_open""")
def ops_counters(t):
    """Orders and their findings counted in one scan: the findings stay an array."""
    found = dev.findings()
    open_row = F.col("_k1") % 3 != 0
    critical = F.size(F.filter(found, lambda d: d.severity == "CRITICAL"))
    return t.silver_orders().agg(
        F.count("*").alias("orders"),
        count_if(F.col("delay_days") > 0).alias("delayed_orders"),
        F.coalesce(F.sum(F.when(open_row, F.size(found))), F.lit(0)).alias("open_deviations"),
        F.coalesce(F.sum(F.when(open_row, critical)), F.lit(0)).alias("critical_open"),
    )


@query("supplier_table", "E24", f"""
SELECT name, region, {rnd('trust_score * 100', 1)} AS trust_pct, total_orders, delayed_orders,
       {rnd('avg_delay_days', 1)} AS avg_delay FROM suppliers""")
def supplier_table(t):
    return t.suppliers().orderBy(F.col("trust_score").asc_nulls_last(), "name").select(
        "name", "region", round_to(F.col("trust_score") * 100, 1).alias("trust_pct"),
        "total_orders", "delayed_orders", round_to("avg_delay_days", 1).alias("avg_delay"),
    )


@query("list_suppliers", "C05", """
SELECT supplier_id, region, trust_score FROM suppliers WHERE region = 'ASIA' AND trust_score IS NOT NULL
ORDER BY trust_score DESC, supplier_id LIMIT 20""")
def list_suppliers(t):
    known = t.suppliers().select("supplier_id", "region", "trust_score").filter(
        F.col("trust_score").isNotNull())
    return ord_ops.listing(
        known, [F.col("trust_score").desc(), F.col("supplier_id").asc()], 20, region="ASIA")


@query("gold_orders", "D01", """
SELECT o.order_id, o.supplier_id, o.order_value, o.delay_days, r.trust_score, r.total_orders, r.delayed_orders,
       r.avg_delay_days,
       CASE WHEN delay_days > 7 THEN 'DELAY' WHEN delay_days > 0 THEN 'MINOR_DELAY' END AS deviation_type,
       CASE WHEN delay_days > 14 THEN 'CRITICAL' WHEN delay_days > 7 THEN 'HIGH' WHEN delay_days > 0 THEN 'MEDIUM' END AS severity
FROM silver_orders o LEFT JOIN supplier_risk r ON o.supplier_id = r.supplier_id""")
def gold_orders(t):
    silver = t.silver_orders()
    flagged = dev.with_delay_flags(silver.select("order_id", "supplier_id", "order_value", "delay_days"))
    return ops.gold_orders(flagged, ops.supplier_risk(silver))


@query("cost_analytics", "E09", f"""
SELECT o.supplier_id, coalesce(s.name, o.supplier_id) AS name, coalesce(s.region, 'Unknown') AS region, total_orders,
       {rnd('spend', 2)} AS total_spend, {rnd('spend / total_orders', 2)} AS avg_order_value,
       {rnd('late_days / nullif(late, 0)', 2)} AS avg_delay_days_when_delayed, delayed_count,
       {rnd('delayed_count::DOUBLE / total_orders * 100', 1)} AS delay_rate_pct,
       {rnd('coalesce(cost, 0)', 2)} AS estimated_delay_cost_usd,
       CASE WHEN spend > 0 THEN {rnd('greatest(0.0::DOUBLE, 1 - coalesce(cost, 0) / spend) * 100', 1)}
            ELSE 100.0::DOUBLE END AS cost_efficiency_score
FROM (SELECT supplier_id, count(*) AS total_orders, {money('order_value')} AS spend,
        CAST(sum(CAST(order_value AS DECIMAL(18,2)) * delay_days * CAST('0.001' AS DECIMAL(4,3)))
             FILTER (WHERE delay_days > 0) AS DOUBLE) AS cost,
        sum(delay_days) FILTER (WHERE delay_days > 0) AS late_days, count(*) FILTER (WHERE delay_days > 0) AS late,
        count(*) FILTER (WHERE status = 'DELAYED') AS delayed_count FROM silver_orders GROUP BY 1) o
LEFT JOIN (SELECT supplier_id, name, region FROM suppliers) s ON o.supplier_id = s.supplier_id""")
def cost_analytics(t):
    return ops.cost_analytics(t.silver_orders(), t.suppliers()).orderBy(
        F.col("total_spend").desc(), "supplier_id")


def bench_sql(where: str) -> str:
    return f"""
SELECT *, row_number() OVER (ORDER BY composite_score DESC, supplier_id) AS rank FROM (
 SELECT o.supplier_id, coalesce(s.name, o.supplier_id) AS name, coalesce(s.region, 'Unknown') AS region,
       coalesce(s.trust_score, 0.0::DOUBLE) AS trust_score, total_orders, delayed_count, delivered_count, product_count,
       {rnd('delays / total_orders', 2)} AS avg_delay_days, {rnd('spend / total_orders', 2)} AS avg_order_value,
       {rnd('delayed_count::DOUBLE / total_orders * 100', 1)} AS delay_rate_pct,
       {rnd('100 - delayed_count::DOUBLE / total_orders * 100', 1)} AS on_time_rate_pct,
       {rnd('coalesce(s.trust_score, 0.0::DOUBLE) * (100 - delayed_count::DOUBLE / total_orders * 100)', 1)} AS composite_score
 FROM (SELECT supplier_id, count(*) AS total_orders, sum(delay_days) AS delays, {money('order_value')} AS spend,
        count(*) FILTER (WHERE status = 'DELAYED') AS delayed_count,
        count(*) FILTER (WHERE status = 'DELIVERED') AS delivered_count, count(DISTINCT product) AS product_count
       FROM silver_orders {where} GROUP BY 1) o
 LEFT JOIN (SELECT supplier_id, name, region, trust_score FROM suppliers) s ON o.supplier_id = s.supplier_id)"""


@query("supplier_benchmarks", "E10 F03", bench_sql(""))
def supplier_benchmarks(t):
    return ops.benchmarks(t.silver_orders(), t.suppliers())


@query("benchmarks_filtered", "C06", bench_sql("WHERE product ILIKE '%Ring%'"))
def benchmarks_filtered(t):
    return ops.benchmarks(t.silver_orders(), t.suppliers(), product="Ring")


@query("supplier_concentration", "E11", f"""
SELECT s.supplier_id, s.name, s.region, s.trust_score, coalesce(s.total_orders, 0) AS total_orders,
       coalesce(s.delayed_orders, 0) AS delayed_orders,
       coalesce(s.delayed_orders::DOUBLE / nullif(s.total_orders, 0) * 100, 0.0::DOUBLE) AS delay_rate_pct,
       coalesce(pct, 0.0::DOUBLE) AS max_product_dependency_pct,
       CASE WHEN pct >= 70 THEN 'HIGH' WHEN pct >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS concentration_risk
FROM suppliers s LEFT JOIN (
  SELECT supplier_id, {rnd('max(n::DOUBLE / total * 100)', 1)} AS pct
  FROM (SELECT supplier_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY product) AS total
        FROM silver_orders GROUP BY supplier_id, product) GROUP BY 1) c ON c.supplier_id = s.supplier_id""")
def supplier_concentration(t):
    return ops.concentration(t.silver_orders(), t.suppliers())


@query("supplier_scorecard", "D15 E12", f"""
SELECT s.supplier_id, strftime(w.week_end, '%Y-%m-%d') AS week, coalesce(n, 0) AS total_orders,
       {rnd('(n - late)::DOUBLE / n * 100', 1)} AS on_time_pct,
       coalesce({rnd('delay::DOUBLE / n', 1)}, 0.0::DOUBLE) AS avg_delay_days, coalesce(d, 0) AS deviation_count
FROM suppliers s
CROSS JOIN (SELECT i, CAST(now AS DATE) - CAST(i * 7 AS INTEGER) AS week_end FROM anchor, range(12) r(i)) w
LEFT JOIN (SELECT supplier_id, date_diff('day', CAST(created_at AS DATE), CAST(now AS DATE)) // 7 AS i, count(*) AS n,
                  count(*) FILTER (WHERE delay_days > 0) AS late, sum(delay_days) AS delay
           FROM silver_orders, anchor WHERE created_at::DATE <= now::DATE GROUP BY 1, 2) o
  ON o.supplier_id = s.supplier_id AND o.i = w.i
LEFT JOIN (SELECT supplier_id, date_diff('day', CAST(detected_at AS DATE), CAST(now AS DATE)) // 7 AS i, count(*) AS d
           FROM deviations, anchor GROUP BY 1, 2) v
  ON v.supplier_id = s.supplier_id AND v.i = w.i""")
def supplier_scorecard(t):
    return ops.scorecard(t.suppliers(), t.silver_orders(), t.deviations("supplier_id"), t.order_anchor())


@query("product_mix", "E19", f"""
SELECT *, {rnd('total_value * 0.2::DOUBLE', 2)} AS shifted_value FROM (
  SELECT supplier_id, product, count(*) AS orders, {money('order_value')} AS total_value,
       row_number() OVER (PARTITION BY supplier_id ORDER BY count(*) DESC, product) AS rank
  FROM silver_orders GROUP BY 1, 2) WHERE rank <= 5""")
def product_mix(t):
    return ops.product_mix(t.silver_orders(), 5, shift_pct=20.0).withColumn(
        "rank", F.col("rank").cast("long"))


@query("supplier_stats_merge", "E17", """
SELECT s.supplier_id, s.total_orders + coalesce(n, 0) AS total_orders,
       s.delayed_orders + coalesce(late, 0) AS delayed_orders,
       CASE WHEN n IS NULL THEN s.avg_delay_days
            ELSE (s.avg_delay_days * s.total_orders + delay) / greatest(1, s.total_orders + n) END AS avg_delay_days,
       CASE WHEN n IS NULL THEN s.trust_score ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE,
         1.0::DOUBLE - ((s.delayed_orders + late)::DOUBLE / greatest(1, s.total_orders + n)::DOUBLE) * 0.5::DOUBLE)) END AS trust_score
FROM stg_suppliers s LEFT JOIN (
  SELECT supplier_id, count(*) AS n, count(*) FILTER (WHERE delay_days > 0) AS late, sum(delay_days) AS delay
  FROM stg_orders WHERE created_at >= TIMESTAMP '2001-01-01' GROUP BY 1) b ON b.supplier_id = s.supplier_id""")
def supplier_stats_merge(t):
    batch = t.bronze_orders("order_id", "supplier_id", "delay_days", "status", "created_at")
    batch = ord_ops.staged_orders(batch).filter(F.col("created_at") >= F.lit("2001-01-01").cast("timestamp_ntz"))
    return ops.merge_statistics(ops.staged_suppliers(t.suppliers()), batch)


@query("alternate_suppliers", "D10", """
SELECT o.order_id, o.supplier_id, o.region, a.supplier_id AS alt_supplier_id, a.trust_score AS alt_trust_score,
       row_number() OVER (PARTITION BY o.order_id ORDER BY a.trust_score DESC, a.supplier_id) AS alt_rank
FROM silver_orders o JOIN suppliers a ON a.region = o.region AND a.supplier_id <> o.supplier_id AND a.trust_score >= 0.75
WHERE o.delay_days > 14 QUALIFY alt_rank <= 3""")
def alternate_suppliers(t):
    late = t.silver_orders().filter(F.col("delay_days") > 14).select("order_id", "supplier_id", "region")
    return ops.alternates_for(late, t.suppliers(), 0.75, 3).withColumn(
        "alt_rank", F.col("alt_rank").cast("long"))


@query("co_affected", "D11", """
SELECT o.order_id, o.supplier_id, c.order_id AS co_order_id, c.status AS co_status, c.expected_delivery AS co_due,
       row_number() OVER (PARTITION BY o.order_id ORDER BY c.expected_delivery, c.order_id) AS co_rank
FROM silver_orders o JOIN (
   SELECT * FROM silver_orders WHERE status NOT IN ('DELIVERED', 'CANCELLED')
   QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY expected_delivery, order_id) <= 6) c
  ON c.supplier_id = o.supplier_id AND c.order_id <> o.order_id
WHERE o.delay_days > 14 QUALIFY co_rank <= 5""")
def co_affected(t):
    silver = t.silver_orders()
    late = silver.filter(F.col("delay_days") > 14).select("order_id", "supplier_id")
    still_open = silver.filter(~F.col("status").isin(rules.CLOSED_STATUSES)).select(
        "order_id", "supplier_id", "status", "expected_delivery")
    return ops.co_affected(late, still_open).withColumn("co_rank", F.col("co_rank").cast("long"))
