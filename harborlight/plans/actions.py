"""Action queries: audit, gate, plans, constraints, order context."""

from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.operators import actions as ops
from harborlight.operators import suppliers as sup
from harborlight.oracle import rnd
from harborlight.registry import query
from harborlight.sources.derived import days


@query("actions_audit", "D06 L05", """
SELECT a.action_id, a.action_type, a.description, a.status, a.created_at, a.completed_at, a.resolved, a.deviation_id,
       d.type AS deviation_type, d.severity, o.order_id, o.supplier_id, o.order_value, o.product
FROM pending_actions a LEFT JOIN deviations d ON d.deviation_id = a.deviation_id
LEFT JOIN silver_orders o ON o.order_id = d.order_id""")
def actions_audit(t):
    return ops.audit(t.pending_actions(), t.deviations(), t.silver_orders()).select(
        "action_id", "action_type", "description", "status", "created_at", "completed_at", "resolved",
        "deviation_id", "deviation_type", "severity", "order_id", "supplier_id", "order_value", "product")


@query("action_success", "E14", f"""
SELECT action_type, count(*) AS total, count(*) FILTER (WHERE resolved) AS resolved_count,
       count(*) FILTER (WHERE resolved AND status <> 'FAILED') AS success_count,
       {rnd("count(*) FILTER (WHERE resolved AND status <> 'FAILED')::DOUBLE / nullif(count(*) FILTER (WHERE resolved), 0) * 100", 1)} AS success_rate_pct,
       {rnd("coalesce(sum(CAST(confidence AS DECIMAL(9,6)))::DOUBLE / nullif(count(confidence), 0), 0)", 3)} AS avg_confidence
FROM pending_actions GROUP BY 1""")
def action_success(t):
    return ops.success_rates(t.pending_actions())


@query("stuck_actions", "C08", """
SELECT a.action_id, a.deviation_id, a.confidence, a.created_at, d.type AS deviation_type, d.severity
FROM pending_actions a JOIN deviations d ON d.deviation_id = a.deviation_id, anchor
WHERE a.status = 'PENDING' AND a.created_at < now - INTERVAL 10 MINUTE""")
def stuck_actions(t):
    return ops.stuck(t.pending_actions(), t.deviations(), t.order_anchor())


@query("low_conf_actions", "C08", """
SELECT action_id, deviation_id, confidence, action_type, description FROM pending_actions, anchor
WHERE status = 'PENDING' AND confidence < 0.4 AND created_at > now - INTERVAL 60 DAY
ORDER BY confidence, action_id LIMIT 10""")
def low_conf_actions(t):
    return ops.low_confidence(t.pending_actions(), t.order_anchor() - days(F.lit(60)))


@query("invalid_reroutes", "C08 B20", """
SELECT action_id, deviation_id, 'ESCALATE' AS new_action_type FROM pending_actions, anchor
WHERE action_type = 'REROUTE' AND status = 'PENDING' AND created_at > now - INTERVAL 2000 DAY
  AND alternate_supplier_id IS NULL""")
def invalid_reroutes(t):
    return ops.invalid_reroutes(t.pending_actions(), t.order_anchor() - days(F.lit(2000)))


@query("payload_extract", "B20", """
SELECT action_id, alternate_supplier_id, payload_severity AS severity, payload_value AS order_value,
       confidence AS execution_confidence FROM pending_actions""")
def payload_extract(t):
    def field(name):
        return F.get_json_object("payload", f"$.{name}")

    return t.pending_actions().select(
        "action_id", field("alternate_supplier_id").alias("alternate_supplier_id"),
        field("severity").alias("severity"), field("order_value").cast("double").alias("order_value"),
        field("execution_confidence").cast("double").alias("execution_confidence"))


@query("ai_health", "E15", f"""
SELECT count(*) FILTER (WHERE status = 'PENDING') AS pending_count,
       count(*) FILTER (WHERE status = 'COMPLETED') AS completed_count,
       {rnd("coalesce(sum(CAST(confidence AS DECIMAL(9,6)))::DOUBLE / nullif(count(confidence), 0), 0)", 3)} AS avg_confidence
FROM pending_actions, anchor WHERE created_at > now - INTERVAL 60 DAY""")
def ai_health(t):
    return ops.health(t.pending_actions(), t.order_anchor() - days(F.lit(60)))


RANK = "CASE {} WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 END"
GATE = f"""
SELECT a.action_id, a.action_type, o.supplier_id, o.order_id, o.region, a.payload_value AS order_value,
  CASE WHEN coalesce(a.confidence, 1.0) < 0.70 THEN 'CONFIDENCE'
       WHEN {RANK.format('a.payload_severity')} >= {RANK.format('p.require_approval_at_severity')} THEN 'SEVERITY'
       WHEN a.payload_value > p.require_approval_above_value THEN 'VALUE' END AS block_reason
FROM pending_actions a JOIN deviations d ON d.deviation_id = a.deviation_id
JOIN silver_orders o ON o.order_id = d.order_id LEFT JOIN policies p ON p.supplier_id = o.supplier_id"""


@query("action_gate", "L06 D18", f"""
SELECT action_id, action_type, supplier_id, order_value, block_reason,
       CASE WHEN block_reason IS NOT NULL THEN 'ESCALATE' ELSE action_type END AS final_action FROM ({GATE})""")
def action_gate(t):
    return gated(t).select(
        "action_id", "action_type", "supplier_id", "order_value", "block_reason", "final_action")


def gated(t):
    return ops.gate(t.pending_actions(), t.deviations(), t.silver_orders(), t.policies())


@query("reroute_plan", "L07 D10", f"""
SELECT g.action_id, g.order_id, g.region, g.supplier_id AS from_supplier, s.supplier_id AS to_supplier,
       {rnd('s.trust_score', 3)} AS alt_trust_score, 'IN_TRANSIT' AS new_status
FROM ({GATE}) g JOIN suppliers s ON s.region = g.region AND s.supplier_id <> g.supplier_id AND s.trust_score >= 0.8
WHERE g.action_type = 'REROUTE' AND g.block_reason IS NULL
QUALIFY row_number() OVER (PARTITION BY g.action_id ORDER BY s.trust_score DESC, s.supplier_id) = 1""")
def reroute_plan(t):
    from harborlight.functions.numeric import round_to

    go = gated(t).filter(F.col("final_action") == "REROUTE").select("action_id", "order_id", "supplier_id").join(
        t.silver_orders().select("order_id", "region"), "order_id")
    return sup.alternates_for(go, t.suppliers(), 0.80, 1).select(
        "action_id", "order_id", "region", F.col("supplier_id").alias("from_supplier"),
        F.col("alt_supplier_id").alias("to_supplier"),
        round_to("alt_trust_score", 3).alias("alt_trust_score"), F.lit("IN_TRANSIT").alias("new_status"))


@query("procurement_events", "L08", """
SELECT 'SAFETY_STOCK_TRIGGER' AS event_type, deviation_id, description, payload_severity AS severity,
       payload_product AS product, coalesce(recommended_quantity, 100) AS recommended_quantity,
       0.0::DOUBLE AS financial_impact_usd
FROM pending_actions WHERE action_type = 'SAFETY_STOCK'""")
def procurement_events(t):
    return ops.procurement_events(t.pending_actions())


@query("applicable_constraints", "D09", """
SELECT o.order_id, c.id, c.entity_id, c.constraint_type, c.value FROM silver_orders o JOIN constraints c
  ON c.entity_id = '*' OR c.entity_id = o.supplier_id OR c.entity_id = o.region OR c.entity_id = o.product""")
def applicable_constraints(t):
    orders = t.silver_orders().select("order_id", "supplier_id", "region", "product")
    return ops.applicable_constraints(orders, t.constraints()).select(
        "order_id", "id", "entity_id", "constraint_type", "value")


@query("list_constraints", "C05", """
SELECT c.id, c.entity_id, c.constraint_type, c.value, c.hard_limit, count(o.order_id) AS orders
FROM constraints c LEFT JOIN silver_orders o ON o.region = c.entity_id
WHERE c.entity_type = 'REGION' GROUP BY ALL ORDER BY 1 LIMIT 100""")
def list_constraints(t):
    """Region constraints with the number of orders each one touches."""
    touched = t.silver_orders().groupBy(F.col("region").alias("entity_id")).agg(F.count("*").alias("orders"))
    return t.constraints().filter(F.col("entity_type") == "REGION").join(touched, "entity_id", "left").select(
        "id", "entity_id", "constraint_type", "value", "hard_limit",
        F.coalesce("orders", F.lit(0)).alias("orders")).orderBy("id").limit(100)


BROKEN = """
SELECT * FROM (
  SELECT o.order_id, c.id, c.constraint_type, c.value, c.hard_limit,
    CASE WHEN c.constraint_type = 'max_delay_days' THEN o.delay_days::DOUBLE
         WHEN c.constraint_type IN ('max_spend_usd', 'anomaly_value_threshold') THEN o.order_value
         WHEN c.constraint_type = 'sla_delivery_days' THEN date_diff('day', o.created_at, coalesce(o.actual_delivery, o.expected_delivery))::DOUBLE
         WHEN c.constraint_type IN ('min_trust_score', 'min_trust_score_threshold') THEN s.trust_score
         WHEN c.constraint_type IN ('min_inventory', 'min_inventory_level') THEN o.inventory_level END AS observed
  FROM silver_orders o JOIN constraints c
    ON c.entity_id = '*' OR c.entity_id = o.supplier_id OR c.entity_id = o.region OR c.entity_id = o.product
  LEFT JOIN suppliers s ON s.supplier_id = o.supplier_id)
WHERE (constraint_type IN ('max_delay_days', 'max_spend_usd', 'anomaly_value_threshold', 'sla_delivery_days') AND observed > value)
   OR (constraint_type IN ('min_trust_score', 'min_trust_score_threshold', 'min_inventory', 'min_inventory_level') AND observed < value)"""


def order_violations(t):
    orders = t.silver_orders().select(
        "order_id", "supplier_id", "region", "product", "delay_days", "order_value", "inventory_level",
        "created_at", "expected_delivery", "actual_delivery")
    matched = ops.applicable_constraints(orders, t.constraints()).join(
        t.suppliers().select("supplier_id", "trust_score"), "supplier_id", "left")
    return ops.violations(matched).select(
        "order_id", "id", "constraint_type", "value", "hard_limit", "observed")


@query("constraint_violations", "K19", BROKEN)
def constraint_violations(t):
    return order_violations(t)


@query("constraint_report", "K19", f"""
WITH broken AS (SELECT id, count(*) AS n FROM ({BROKEN}) GROUP BY 1),
named AS (SELECT order_id, supplier_id, delay_days, inventory_level, quantity, created_at, unnest(['*', supplier_id, region, product]) AS entity_id FROM silver_orders),
entity AS (SELECT entity_id, count(*) AS n, count(*) FILTER (WHERE delay_days > 0) AS late, sum(delay_days) AS days,
  sum(CAST(inventory_level AS DECIMAL(18,4)))::DOUBLE / count(inventory_level)
    * (date_diff('day', min(created_at)::DATE, max(created_at)::DATE) + 1) / sum(quantity)::DOUBLE AS cover FROM named GROUP BY 1),
top AS (SELECT entity_id, max(n) AS n FROM (SELECT entity_id, supplier_id, count(*) AS n FROM named GROUP BY 1, 2) GROUP BY 1),
seen AS (SELECT c.id, c.constraint_type, c.value, c.hard_limit, coalesce(b.n, 0) AS broken_orders,
   CASE WHEN c.constraint_type IN ('max_delay_days', 'max_spend_usd', 'anomaly_value_threshold', 'sla_delivery_days', 'min_trust_score',
          'min_trust_score_threshold', 'min_inventory', 'min_inventory_level') THEN 'ORDER'
        WHEN c.constraint_type IN ('max_delay_rate_pct', 'max_avg_delay_days', 'max_single_supplier_pct', 'min_safety_stock_days') THEN 'ENTITY'
        ELSE 'UNKNOWN' END AS level,
   {rnd("CASE c.constraint_type WHEN 'max_delay_rate_pct' THEN e.late * 100.0::DOUBLE / e.n WHEN 'max_avg_delay_days' THEN e.days::DOUBLE / e.n WHEN 'max_single_supplier_pct' THEN t.n * 100.0::DOUBLE / e.n WHEN 'min_safety_stock_days' THEN e.cover END", 4)} AS observed
 FROM constraints c LEFT JOIN broken b ON b.id = c.id LEFT JOIN entity e ON e.entity_id = c.entity_id LEFT JOIN top t ON t.entity_id = c.entity_id)
SELECT id, constraint_type, level, observed, broken_orders,
  CASE WHEN level = 'ORDER' THEN broken_orders > 0 WHEN constraint_type = 'min_safety_stock_days' THEN observed < value
    WHEN level = 'ENTITY' THEN observed > value END AS broken FROM seen""")
def constraint_report(t):
    """Every constraint with what became of it, unknown kinds and entities without orders among them."""
    orders = t.silver_orders().select(
        "supplier_id", "region", "product", "delay_days", "inventory_level", "quantity", "created_at")
    return ops.constraint_report(t.constraints(), orders, order_violations(t))


@query("deviation_context", "D19 D09 D10 D11", """
SELECT o.order_id, o.supplier_id, s.trust_score,
  (SELECT count(*) FROM constraints c WHERE c.entity_id IN ('*', o.supplier_id, o.region, o.product)) AS constraint_count,
  coalesce(co.ids, '') AS co_affected_orders, coalesce(al.ids, '') AS alternate_suppliers
FROM silver_orders o LEFT JOIN suppliers s ON s.supplier_id = o.supplier_id
LEFT JOIN (SELECT order_id, string_agg(co, ',' ORDER BY k) AS ids FROM (
     SELECT a.order_id, c.order_id AS co, row_number() OVER (PARTITION BY a.order_id ORDER BY c.expected_delivery, c.order_id) AS k
     FROM silver_orders a JOIN (SELECT * FROM silver_orders WHERE status NOT IN ('DELIVERED', 'CANCELLED')
       QUALIFY row_number() OVER (PARTITION BY supplier_id ORDER BY expected_delivery, order_id) <= 6) c
       ON c.supplier_id = a.supplier_id AND c.order_id <> a.order_id WHERE a.delay_days > 14) WHERE k <= 5 GROUP BY 1) co
  ON co.order_id = o.order_id
LEFT JOIN (SELECT order_id, string_agg(alt, ',' ORDER BY k) AS ids FROM (
     SELECT a.order_id, x.supplier_id AS alt, row_number() OVER (PARTITION BY a.order_id ORDER BY x.trust_score DESC, x.supplier_id) AS k
     FROM silver_orders a JOIN suppliers x ON x.region = a.region AND x.supplier_id <> a.supplier_id AND x.trust_score >= 0.75
     WHERE a.delay_days > 14) WHERE k <= 3 GROUP BY 1) al ON al.order_id = o.order_id
WHERE o.delay_days > 14""")
def deviation_context(t):
    """One row per badly late order with all that an analyst would look up."""
    silver, suppliers, k = t.silver_orders(), t.suppliers(), 3
    late = silver.filter(F.col("delay_days") > 14).select("order_id", "supplier_id", "region", "product")
    still_open = silver.filter(~F.col("status").isin(rules.CLOSED_STATUSES)).select(
        "order_id", "supplier_id", "status", "expected_delivery")

    def listed(rows, rank, name, out):
        pairs = F.sort_array(F.collect_list(F.struct(rank, name)))
        return rows.groupBy("order_id").agg(F.array_join(F.transform(pairs, lambda p: p[name]), ",").alias(out))

    co = listed(sup.co_affected(late.select("order_id", "supplier_id"), still_open, 5),
                "co_rank", "co_order_id", "co_affected_orders")
    alt = listed(sup.alternates_for(late.select("order_id", "supplier_id", "region"), suppliers, 0.75, k),
                 "alt_rank", "alt_supplier_id", "alternate_suppliers")
    rule_count = ops.applicable_constraints(late, t.constraints()).groupBy("order_id").agg(
        F.count("*").alias("constraint_count"))
    return (
        late.select("order_id", "supplier_id")
        .join(suppliers.select("supplier_id", "trust_score"), "supplier_id", "left")
        .join(rule_count, "order_id", "left").join(co, "order_id", "left").join(alt, "order_id", "left")
        .select("order_id", "supplier_id", "trust_score", "constraint_count",
                F.coalesce("co_affected_orders", F.lit("")).alias("co_affected_orders"),
                F.coalesce("alternate_suppliers", F.lit("")).alias("alternate_suppliers"))
    )
