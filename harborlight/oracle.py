"""Check SQL: hand-written DuckDB common table expressions and their assembly.

These are written from the meaning of the tables, not from our Spark plans. A
query names the tables it needs; ``compose`` puts the needed ones in front.
"""

from __future__ import annotations

import re


def rnd(expr: str, digits: int) -> str:
    """Round half up the way both engines do alike."""
    scale = 10**digits
    return f"(floor(({expr})::DOUBLE * {scale}::DOUBLE + 0.5::DOUBLE) / {scale}::DOUBLE)"


def money(expr: str) -> str:
    return f"CAST(sum(CAST({expr} AS DECIMAL(18,2))) AS DOUBLE)"


ORDER_STATUS = "('PENDING','IN_TRANSIT','DELIVERED','DELAYED','CANCELLED')"

TABLES: dict[str, str] = {}

TABLES["raw_orders"] = f"""
SELECT CASE WHEN key = 0 THEN '' WHEN key = 1 THEN NULL
            ELSE 'ORD-' || l_orderkey || '-' || l_linenumber END AS order_id,
       s_name AS supplier_id, p_name AS product, r_name AS region,
       CAST(l_quantity AS INTEGER) AS quantity,
       {rnd('l_extendedprice / l_quantity', 2)} AS unit_price,
       l_extendedprice AS order_value,
       l_shipdate AS expected_delivery,
       CASE WHEN status IN ('DELIVERED', 'DELAYED')
            THEN l_shipdate + to_days(CAST(greatest(coalesce(delay_days, 0), 0) AS INTEGER)) END AS actual_delivery,
       CAST(delay_days AS INTEGER) AS delay_days, status,
       CAST((l_partkey * 7 + l_suppkey * 13 + l_linenumber) % 101 AS DOUBLE) AS inventory_level,
       o_orderdate AS created_at, l_partkey AS _k1, l_suppkey AS _k2
FROM (
  SELECT *, CASE WHEN l_partkey % 53 = 0 THEN 'CRF'
                 WHEN o_orderstatus = 'P' AND l_returnflag = 'R' THEN 'CANCELLED'
                 WHEN o_orderstatus = 'P' THEN 'PENDING'
                 WHEN o_orderstatus = 'O' THEN 'IN_TRANSIT'
                 WHEN delay_days > 0 THEN 'DELAYED' ELSE 'DELIVERED' END AS status
  FROM (
    SELECT l.*, o.o_orderstatus, o.o_orderdate, s.s_name, p.p_name, r.r_name,
           (l.l_partkey + l.l_linenumber) % 211 AS key,
           CASE (l.l_suppkey + l.l_partkey) % 101 WHEN 0 THEN -1 WHEN 1 THEN 400 WHEN 2 THEN NULL
                ELSE greatest(0, ((date_diff('day', o.o_orderdate, l.l_shipdate) % 40) + 40) % 40 - 20) END AS delay_days
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
    LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
    LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
    LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
    LEFT JOIN part p ON l.l_partkey = p.p_partkey))
"""

TABLES["anchor"] = "SELECT max(l_shipdate) AS now FROM lineitem"
TABLES["event_anchor"] = "SELECT max(ts) AS now FROM events"

TABLES["silver_orders"] = """
SELECT * EXCLUDE (rn) FROM (
  SELECT * REPLACE (coalesce(delay_days, 0) AS delay_days),
         row_number() OVER (PARTITION BY order_id
            ORDER BY expected_delivery DESC, _k1 DESC, _k2 DESC, order_value DESC) AS rn
  FROM raw_orders
  WHERE order_id IS NOT NULL AND trim(order_id) <> '' AND coalesce(delay_days, 0) BETWEEN 0 AND 365)
WHERE rn = 1
"""

TABLES["stg_orders"] = f"""
SELECT * REPLACE (coalesce(delay_days, 0) AS delay_days) FROM raw_orders
WHERE order_id IS NOT NULL AND order_id <> '' AND status IN {ORDER_STATUS}
"""

TABLES["fct_shipments"] = """
SELECT *, CAST(CASE WHEN actual_delivery IS NOT NULL AND expected_delivery IS NOT NULL
            THEN date_part('day', actual_delivery - expected_delivery) ELSE delay_days END AS INTEGER) AS calculated_delay_days
FROM stg_orders WHERE status IN ('DELIVERED', 'DELAYED', 'IN_TRANSIT')
"""

TABLES["supplier_risk"] = """
SELECT supplier_id, total_orders, delayed_orders,
       delay_sum::DOUBLE / total_orders::DOUBLE AS avg_delay_days,
       greatest(0.0::DOUBLE, least(1.0::DOUBLE,
          1.0::DOUBLE - (delayed_orders::DOUBLE / greatest(total_orders, 1)::DOUBLE) * 0.5::DOUBLE)) AS trust_score,
       delayed_orders::DOUBLE / greatest(total_orders, 1)::DOUBLE * 100.0::DOUBLE AS delay_rate_pct
FROM (SELECT supplier_id, count(*) AS total_orders, count(*) FILTER (WHERE delay_days > 0) AS delayed_orders,
             sum(delay_days) AS delay_sum FROM silver_orders WHERE supplier_id IS NOT NULL GROUP BY 1)
"""

TABLES["suppliers"] = """
SELECT s.s_name AS supplier_id, s.s_name AS name, r.r_name AS region,
       CASE WHEN s.s_suppkey % 17 <> 0 THEN k.trust_score END AS trust_score,
       k.total_orders, k.delayed_orders, k.avg_delay_days, s.s_suppkey AS _key
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN supplier_risk k ON k.supplier_id = s.s_name
"""

TABLES["stg_suppliers"] = """
SELECT supplier_id, name, region, coalesce(trust_score, 1.0::DOUBLE) AS trust_score,
       coalesce(total_orders, 0) AS total_orders, coalesce(delayed_orders, 0) AS delayed_orders,
       coalesce(avg_delay_days, 0.0::DOUBLE) AS avg_delay_days
FROM suppliers WHERE supplier_id IS NOT NULL
"""

TABLES["policies"] = """
SELECT s_name AS supplier_id,
       CASE s_suppkey % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END
         AS require_approval_at_severity,
       20000.0::DOUBLE + 1000.0::DOUBLE * (s_suppkey % 60) AS require_approval_above_value
FROM supplier
"""

TABLES["freight_rates"] = """
SELECT CASE WHEN s_suppkey % 23 <> 0 THEN s_name END AS carrier, n_name AS orig_port, r_name AS dest_port,
       abs(s_acctbal) AS min_cost, CAST(s_suppkey % 15 AS INTEGER) AS transit_days,
       CASE WHEN s_suppkey % 2 = 0 THEN ' air ' ELSE 'Ground' END AS mode
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""

TABLES["freight_silver"] = f"""
SELECT carrier, orig_port, dest_port, min_cost, transit_days, upper(trim(mode)) AS mode,
       CASE WHEN transit_days > 0 THEN {rnd('min_cost / transit_days', 2)} ELSE 0.0::DOUBLE END AS cost_per_day
FROM freight_rates WHERE carrier IS NOT NULL AND orig_port IS NOT NULL AND dest_port IS NOT NULL
"""

TABLES["wh_silver"] = """
SELECT * FROM (
  SELECT CASE WHEN s_suppkey % 29 <> 0 THEN s_name END AS plant_code,
         CAST((s_suppkey * 37) % 500 AS INTEGER) AS daily_capacity FROM supplier)
WHERE plant_code IS NOT NULL AND daily_capacity > 0
"""

TABLES["plant_ports"] = """
SELECT DISTINCT s_name AS plant_code, n_name AS port
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON l_suppkey = s_suppkey
"""

TABLES["products_per_plant"] = """
SELECT DISTINCT s_name AS plant_code, p_brand AS product_id
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
"""

TABLES["deviations"] = """
SELECT o.order_id, o.supplier_id, o.product, o.region, o.order_value, o.delay_days, o._k1, o._k2,
       d.type, d.severity, d.recommended_action,
       'DEV-' || o.order_id || '-' || d.type AS deviation_id,
       o.expected_delivery AS detected_at, o._k1 % 3 = 0 AS executed
FROM silver_orders o JOIN (
  SELECT order_id, 'DELAY' AS type,
         CASE WHEN delay_days > 14 THEN 'CRITICAL' WHEN delay_days > 7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
         'Escalate to supplier ' || supplier_id || ': order delayed ' || delay_days || ' days' AS recommended_action
  FROM silver_orders WHERE delay_days > 0
  UNION ALL
  SELECT order_id, 'STOCKOUT', CASE WHEN inventory_level < 5 THEN 'HIGH' ELSE 'MEDIUM' END,
         CASE WHEN inventory_level < 5 THEN 'Emergency' ELSE 'Schedule' END || ' restock for ' || product
           || ' — inventory at ' || printf('%.1f', inventory_level) || '%'
  FROM silver_orders WHERE inventory_level < 10
  UNION ALL
  SELECT order_id, 'ANOMALY', 'MEDIUM',
         'Review unusually high order value $' || format('{:,.2f}', order_value) || ' from ' || supplier_id
  FROM silver_orders WHERE order_value > 100000) d USING (order_id)
"""

TABLES["pending_actions"] = """
SELECT *, CASE WHEN status = 'COMPLETED'
               THEN created_at + to_minutes(CAST(_k2 % 120 AS INTEGER)) END AS completed_at
FROM (
  SELECT 'ACT-' || deviation_id AS action_id, deviation_id, recommended_action AS description,
       CASE _k1 % 4 WHEN 0 THEN 'REROUTE' WHEN 1 THEN 'EXPEDITE' WHEN 2 THEN 'SAFETY_STOCK' ELSE 'NOTIFY' END AS action_type,
       CASE _k2 % 4 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'COMPLETED' WHEN 2 THEN 'CANCELLED' ELSE 'FAILED' END AS status,
       CASE WHEN _k1 % 10 <> 9 THEN (_k1 % 100)::DOUBLE / 100.0::DOUBLE END AS confidence,
       _k1 % 2 = 0 AS resolved,
       detected_at + to_minutes(CAST(_k1 % 25 + 5 AS INTEGER)) AS created_at,
       CASE WHEN (_k1 + _k2) % 3 <> 0 THEN 'ALT-' || _k2 END AS alternate_supplier_id,
       CASE WHEN _k1 % 3 = 0 THEN _k1 % 50 + 1 END AS recommended_quantity,
       severity AS payload_severity, order_value AS payload_value, product AS payload_product, _k1, _k2
  FROM deviations WHERE severity IN ('HIGH', 'CRITICAL'))
"""

TABLES["constraints"] = """
SELECT * FROM (VALUES
 (1, '*', 'GLOBAL', 'max_delay_days', 7.0::DOUBLE, true),
 (2, '*', 'GLOBAL', 'min_inventory_level', 20.0, true),
 (3, '*', 'GLOBAL', 'max_single_supplier_pct', 40.0, true),
 (4, '*', 'GLOBAL', 'anomaly_value_threshold', 100000.0, false),
 (5, '*', 'GLOBAL', 'min_trust_score_threshold', 0.70, true),
 (6, 'Supplier#000000004', 'SUPPLIER', 'max_delay_days', 3.0, true),
 (7, 'Supplier#000000007', 'SUPPLIER', 'min_trust_score', 0.95, true),
 (8, 'Supplier#000000001', 'SUPPLIER', 'max_spend_usd', 50000.0, false),
 (9, 'ASIA', 'REGION', 'max_spend_usd', 90000.0, false),
 (10, 'EUROPE', 'REGION', 'max_delay_days', 5.0, true),
 (11, 'AFRICA', 'REGION', 'min_inventory', 10.0, false),
 (12, 'small ring', 'PRODUCT', 'max_delay_days', 2.0, true),
 (13, 'red widget', 'PRODUCT', 'max_spend_usd', 60000.0, false),
 (14, 'hot gear', 'PRODUCT', 'min_inventory_level', 14.0, true),
 (15, 'Supplier#000000004', 'SUPPLIER', 'max_delay_rate_pct', 15.0, true),
 (16, 'ASIA', 'REGION', 'max_avg_delay_days', 3.0, true),
 (17, 'Supplier#000000002', 'SUPPLIER', 'sla_delivery_days', 60.0, true),
 (18, 'EUROPE', 'REGION', 'max_single_supplier_pct', 5.0, true),
 (19, 'AMERICA', 'REGION', 'max_delay_rate_pct', 99.0, false),
 (20, 'Supplier#000000003', 'SUPPLIER', 'min_safety_stock_days', 14.0, true),
 (21, 'Supplier#000000001', 'SUPPLIER', 'probation_flag', 1.0, true),
 (22, 'nobody', 'SUPPLIER', 'max_delay_rate_pct', 10.0, true),
 (23, 'small ring', 'PRODUCT', 'min_safety_stock_days', 14.0, true),
 (24, 'ASIA', 'REGION', 'preferred_carrier_required', 1.0, false)
) t(id, entity_id, entity_type, constraint_type, value, hard_limit)
"""

TABLES["stream_events"] = """
SELECT CASE WHEN e = 'signup' THEN 'DEMAND_SPIKE' ELSE 'ORDER' END AS event_type,
       event_id, ts AS event_time,
       'EV-' || user_id || '-' || k % 10 AS order_id,
       'SUP-' || user_id % 25 AS supplier_id, 'PROD-' || k % 14 AS product,
       CASE user_id % 4 WHEN 0 THEN 'NA' WHEN 1 THEN 'EMEA' WHEN 2 THEN 'APAC' ELSE 'LATAM' END AS region,
       k AS quantity, value AS unit_price,
       floor(value * k * 1000.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS order_value,
       k % 20 AS delay_days,
       CASE WHEN e = 'view' THEN 'PENDING' WHEN e = 'click' THEN 'IN_TRANSIT' WHEN e = 'error' THEN 'BROKEN'
            WHEN e = 'purchase' AND k % 20 > 0 THEN 'DELAYED' WHEN e = 'purchase' THEN 'DELIVERED' END AS status,
       CAST((k * 37 + user_id) % 101 AS DOUBLE) AS inventory_level,
       value AS forecast_delta_pct, CAST(k % 21 AS DOUBLE) AS current_inventory_days
FROM (SELECT *, event_type AS e, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""

# the rules an order or demand event must meet, as a comma-separated list of the broken ones
TABLES["validated_events"] = f"""
SELECT *, concat_ws(',',
   CASE WHEN event_type = 'ORDER' AND quantity < 1 THEN 'quantity' END,
   CASE WHEN event_type = 'ORDER' AND unit_price < 0 THEN 'unit_price' END,
   CASE WHEN event_type = 'ORDER' AND order_value < 0 THEN 'order_value' END,
   CASE WHEN event_type = 'ORDER' AND delay_days < 0 THEN 'delay_days' END,
   CASE WHEN event_type = 'ORDER' AND status NOT IN {ORDER_STATUS} THEN 'status' END,
   CASE WHEN event_type = 'ORDER' AND (inventory_level < 0 OR inventory_level > 100) THEN 'inventory_level' END,
   CASE WHEN event_type = 'DEMAND_SPIKE' AND current_inventory_days < 0 THEN 'current_inventory_days' END) AS errors
FROM stream_events
"""

TABLES["order_events"] = "SELECT * FROM validated_events WHERE event_type = 'ORDER' AND errors = ''"

TABLES["order_log"] = """
SELECT event_id, event_time, order_id, supplier_id, region, status AS new_status, delay_days AS new_delay_days,
       old_status, old_delay_days, CAST(rn AS BIGINT) AS aggregate_version,
       CASE WHEN rn = 1 THEN 'CREATED'
            WHEN old_status <> status AND status IN ('DELIVERED', 'CANCELLED') THEN status
            WHEN old_status <> status THEN 'STATUS_CHANGED'
            WHEN old_delay_days <> delay_days THEN 'DELAY_UPDATED' ELSE 'SNAPSHOT' END AS event_type
FROM (SELECT *, row_number() OVER w AS rn, lag(status) OVER w AS old_status, lag(delay_days) OVER w AS old_delay_days
      FROM order_events WINDOW w AS (PARTITION BY order_id ORDER BY event_time, event_id))
"""

TABLES["lineage_events"] = """
SELECT event_id AS run_id, 'job-' || user_id % 40 AS job_name,
       CASE WHEN event_type IN ('view', 'signup') THEN 'START'
            WHEN event_type IN ('click', 'purchase') THEN 'COMPLETE' ELSE 'FAIL' END AS event_type,
       'ds-' || k % 30 AS input_1, 'ds-' || (k + 7) % 30 AS input_2, 'ds-' || (30 + user_id % 40) AS output,
       ts AS created_at
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)
"""

TABLES["audit_log"] = """
SELECT event_id AS id, ts AS created_at, sha256('E' || event_id) AS row_hash,
       CASE WHEN event_id = 0 THEN repeat('0', 64) WHEN event_id % 997 = 5 THEN sha256('X' || event_id)
            WHEN event_id % 991 = 7 THEN sha256('E' || (event_id - 2))
            ELSE sha256('E' || (event_id - 1)) END AS prev_hash
FROM events
"""

TABLES["escalations"] = """
SELECT event_id AS id, CASE k % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
       CASE WHEN k % 2 = 0 THEN 'RESOLVED' ELSE 'OPEN' END AS status, ts AS created_at,
       CASE WHEN k % 2 = 0 THEN ts + to_minutes(k) END AS resolved_at
FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error')
"""


# large tables that one query names several times
SHARED = {"pending_actions", "deviations", "silver_orders"}
MATERIALIZED = "MATERIALIZED "


def compose(body: str) -> str:
    """The query with the derived tables it uses, directly or not, in front of it."""
    needed: list[str] = []

    def visit(sql: str, parents: tuple[str, ...]) -> None:
        words = set(re.findall(r"[a-z_0-9]+", sql))
        for name in TABLES:
            if name in words and name not in needed and name not in parents:
                visit(TABLES[name], (*parents, name))
                if name not in needed:
                    needed.append(name)

    visit(body, ())
    if not needed:
        return body.strip()
    ctes = ",\n".join(f"{name} AS {MATERIALIZED if name in SHARED else ''}({TABLES[name].strip()})" for name in needed)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
