"""Deviation queries: listings, trends, clusters, costs, windows over time."""

from pyspark.sql import functions as F

from harborlight.functions.numeric import count_if, money_sum, ratio, round_to
from harborlight.operators import alerts as ops
from harborlight.operators import deviations as dev
from harborlight.operators import orders as ord_ops
from harborlight.operators import suppliers as sup
from harborlight.operators.freight import freight_silver, warehouse_silver
from harborlight.oracle import money, rnd
from harborlight.registry import query
from harborlight.sources.derived import days

ALERT_COLUMNS = ["deviation_id", "order_id", "type", "severity", "detected_at", "executed"]


@query("list_alerts", "C05 G03", """
SELECT deviation_id, order_id, type, severity, detected_at, executed FROM deviations
WHERE severity = 'CRITICAL' AND NOT executed ORDER BY detected_at DESC, deviation_id LIMIT 100 OFFSET 20""")
def list_alerts(t):
    return ord_ops.listing(
        t.deviations().select(*ALERT_COLUMNS),
        [F.col("detected_at").desc(), F.col("deviation_id").asc()], 100, 20,
        severity="CRITICAL", executed=False, type=None,
    )


@query("open_deviations", "G05", """
SELECT deviation_id, order_id, type, severity, detected_at, executed FROM deviations
WHERE NOT executed ORDER BY detected_at DESC, deviation_id LIMIT 20""")
def open_deviations(t):
    return ord_ops.listing(
        t.deviations().select(*ALERT_COLUMNS),
        [F.col("detected_at").desc(), F.col("deviation_id").asc()], 20, executed=False)


@query("bulk_triage", "G05 D04", """
SELECT d.deviation_id, d.order_id, d.type, d.severity, d.detected_at, o.order_value, s.name AS supplier, d.recommended_action
FROM deviations d JOIN silver_orders o ON o.order_id = d.order_id LEFT JOIN suppliers s ON s.supplier_id = o.supplier_id
WHERE d.severity = 'HIGH' AND NOT d.executed ORDER BY d.detected_at DESC, d.deviation_id LIMIT 50""")
def bulk_triage(t):
    """The page is cut first; only its rows meet the orders and suppliers."""
    page = ord_ops.listing(
        t.deviations(), [F.col("detected_at").desc(), F.col("deviation_id").asc()], 50,
        severity="HIGH", executed=False)
    orders = t.silver_orders().select("order_id", "supplier_id", "order_value")
    names = t.supplier_places().select(F.col("s_name").alias("supplier_id"), F.col("s_name").alias("supplier"))
    return page.join(orders, "order_id").join(names, "supplier_id", "left").select(
        "deviation_id", "order_id", "type", "severity", "detected_at", "order_value", "supplier",
        "recommended_action")


@query("recent_alerts", "C07", """
SELECT deviation_id, severity, detected_at FROM deviations, anchor WHERE detected_at >= now - INTERVAL 30 DAY""")
def recent_alerts(t):
    return t.deviations().filter(
        F.col("detected_at") >= t.order_anchor() - days(F.lit(30))
    ).select("deviation_id", "severity", "detected_at")


@query("alerts_trend", "D16 E07", """
SELECT strftime(day, '%Y-%m-%d') AS date, count(*) FILTER (WHERE severity = 'CRITICAL') AS "CRITICAL",
       count(*) FILTER (WHERE severity = 'HIGH') AS "HIGH",
       count(*) FILTER (WHERE severity NOT IN ('CRITICAL', 'HIGH')) AS "MEDIUM", count(severity) AS total
FROM (SELECT CAST(now AS DATE) - CAST(i AS INTEGER) AS day FROM anchor, range(30) r(i)) c
LEFT JOIN deviations d ON CAST(d.detected_at AS DATE) = c.day GROUP BY 1""")
def alerts_trend(t):
    return ops.trend(t.deviations(), t.order_anchor(), 30)


@query("alert_clusters", "E08 D04", """
SELECT d.type, o.supplier_id, count(*) AS count, count(*) FILTER (WHERE d.severity = 'CRITICAL') AS critical_count,
       max(d.detected_at) AS last_seen
FROM deviations d JOIN silver_orders o ON o.order_id = d.order_id, anchor
WHERE d.detected_at >= now - INTERVAL 90 DAY GROUP BY 1, 2 ORDER BY count DESC, 1, 2 LIMIT 50""")
def alert_clusters(t):
    """The deviation carries its supplier, so counting needs no join."""
    return ops.clusters(t.deviations("supplier_id"), t.order_anchor() - days(F.lit(90)))


@query("alerts_enriched", "B18 D05", f"""
SELECT d.deviation_id, d.order_id, d.type, d.severity, d.detected_at, d.executed, o.supplier_id, o.product, o.region,
       {rnd('coalesce(o.order_value, 0)', 2)} AS order_value, coalesce(o.delay_days, 0) AS delay_days,
       {rnd('coalesce(o.delay_days, 0)::DOUBLE * coalesce(o.order_value, 0.0::DOUBLE) * 0.02::DOUBLE', 2)} AS cost_impact_usd,
       CASE WHEN {rnd('coalesce(o.delay_days, 0)::DOUBLE * coalesce(o.order_value, 0.0::DOUBLE) * 0.02::DOUBLE', 2)} >= 10000 THEN 'CRITICAL_COST'
            WHEN {rnd('coalesce(o.delay_days, 0)::DOUBLE * coalesce(o.order_value, 0.0::DOUBLE) * 0.02::DOUBLE', 2)} >= 2000 THEN 'HIGH_COST'
            ELSE 'MODERATE' END AS risk_tier
FROM (SELECT deviation_id, order_id, type, severity, detected_at, executed FROM deviations UNION ALL
      SELECT 'GONE-' || deviation_id, 'GONE-' || order_id, type, severity, detected_at, executed FROM deviations
      WHERE type = 'STOCKOUT' AND _k1 % 10 = 0) d LEFT JOIN silver_orders o ON o.order_id = d.order_id""")
def alerts_enriched(t):
    """All deviations, and added ones of orders that are not there."""
    found = t.deviations("_k1")
    gone = [F.concat(F.lit("GONE-"), F.col(c)).alias(c) for c in ("deviation_id", "order_id")]
    orphans = found.filter((F.col("type") == "STOCKOUT") & (F.col("_k1") % 10 == 0)).select(
        *gone, *[c for c in ALERT_COLUMNS if c not in ("deviation_id", "order_id")])
    return ops.enriched(found.select(*ALERT_COLUMNS).unionByName(orphans), t.silver_orders())


@query("alerts_cost_total", "B18", f"""
SELECT risk_tier, count(*) AS alerts, {money('cost')} AS total_cost_impact_usd
FROM (SELECT cost, CASE WHEN cost >= 10000 THEN 'CRITICAL_COST' WHEN cost >= 2000 THEN 'HIGH_COST' ELSE 'MODERATE' END AS risk_tier
      FROM (SELECT {rnd('delay_days::DOUBLE * order_value * 0.02::DOUBLE', 2)} AS cost FROM deviations))
GROUP BY 1""")
def alerts_cost_total(t):
    rows = ops.enriched(t.deviations().select(*ALERT_COLUMNS), t.silver_orders())
    return rows.groupBy("risk_tier").agg(
        F.count("*").alias("alerts"), money_sum("cost_impact_usd").alias("total_cost_impact_usd"))


@query("recent_critical", "E16 D04", """
SELECT o.supplier_id, count(*) AS recent_critical FROM deviations d JOIN silver_orders o ON o.order_id = d.order_id, anchor
WHERE d.severity = 'CRITICAL' AND d.detected_at >= now - INTERVAL 60 DAY GROUP BY 1""")
def recent_critical(t):
    return ops.critical_since(t.deviations(), t.silver_orders(), t.order_anchor() - days(F.lit(60)))


@query("rolling_critical", "F10", """
SELECT DISTINCT supplier_id, detected_at, CAST(count(*) OVER (PARTITION BY supplier_id ORDER BY detected_at
         RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS BIGINT) AS critical_24h
FROM deviations WHERE severity = 'CRITICAL'""")
def rolling_critical(t):
    return ops.rolling_critical(t.deviations("supplier_id"))


@query("orders_with_critical", "D13", """
SELECT order_id, supplier_id, order_value FROM silver_orders
WHERE order_id IN (SELECT order_id FROM deviations WHERE severity = 'CRITICAL' AND NOT executed)""")
def orders_with_critical(t):
    hot = t.deviations().filter((F.col("severity") == "CRITICAL") & ~F.col("executed"))
    return t.silver_orders().select("order_id", "supplier_id", "order_value").join(
        hot, "order_id", "left_semi")


@query("demand_anchor", "D12", """
SELECT e.event_id, e.supplier_id AS signal, o.order_id, e.product, e.region FROM (
  SELECT event_id, supplier_id, CASE event_id % 4 WHEN 0 THEN 'small ring' WHEN 1 THEN 'red widget'
           WHEN 2 THEN 'hot gear' ELSE 'no such part' END AS product,
         CASE region WHEN 'NA' THEN 'AMERICA' WHEN 'EMEA' THEN 'EUROPE' WHEN 'APAC' THEN 'ASIA' ELSE 'AFRICA' END AS region
  FROM stream_events WHERE event_type = 'DEMAND_SPIKE' AND forecast_delta_pct >= 25 AND current_inventory_days < 7) e
JOIN (SELECT * FROM silver_orders WHERE status NOT IN ('DELIVERED', 'CANCELLED')
      QUALIFY row_number() OVER (PARTITION BY product, region ORDER BY created_at DESC, order_id DESC) = 1) o
  ON o.product = e.product AND o.region = e.region""")
def demand_anchor(t):
    """Demand signals, renamed to the parts and regions of the order table."""
    n = F.col("event_id") % 4
    signals = dev.preemptive_stockouts(
        t.stream_events().filter(F.col("event_type") == "DEMAND_SPIKE")
    ).select(
        "event_id", F.col("supplier_id").alias("signal"),
        F.when(n == 0, "small ring").when(n == 1, "red widget").when(n == 2, "hot gear")
        .otherwise("no such part").alias("product"),
        F.when(F.col("region") == "NA", "AMERICA").when(F.col("region") == "EMEA", "EUROPE")
        .when(F.col("region") == "APAC", "ASIA").otherwise("AFRICA").alias("region"),
    )
    return dev.anchor_to_orders(signals, t.silver_orders().select(
        "order_id", "product", "region", "status", "created_at")).select(
        "event_id", "signal", "order_id", "product", "region")


# events fall into one month, orders into years; 80 months of orders go by in the month of events
SIGNAL_TIME = "make_timestamp((epoch_us(event_time) - 1704067200000000) * 80 + 788918400000000)"
SIGNALS = f"""
  SELECT event_id, supplier_id AS signal, CASE event_id % 4 WHEN 0 THEN 'small ring' WHEN 1 THEN 'red widget'
           WHEN 2 THEN 'hot gear' ELSE 'no such part' END AS product,
         CASE region WHEN 'NA' THEN 'AMERICA' WHEN 'EMEA' THEN 'EUROPE' WHEN 'APAC' THEN 'ASIA' ELSE 'AFRICA' END AS region,
         {SIGNAL_TIME} AS signal_time
  FROM stream_events WHERE event_type = 'DEMAND_SPIKE'"""


@query("demand_as_of", "D12", f"""
SELECT e.event_id, e.signal, o.order_id, e.product, e.region, e.signal_time FROM ({SIGNALS}) e
ASOF JOIN (SELECT product, region, created_at, max(order_id) AS order_id FROM silver_orders
           WHERE status NOT IN ('DELIVERED', 'CANCELLED') GROUP BY ALL) o
  ON o.product = e.product AND o.region = e.region AND e.signal_time >= o.created_at""")
def demand_as_of(t):
    """All demand signals, each with the open order that was the newest at its time."""
    n = F.col("event_id") % 4
    micros = (F.unix_micros("event_time") - 1704067200000000) * 80 + 788918400000000
    signals = t.stream_events().withColumn("event_time", F.col("event_time").cast("timestamp")).filter(
        F.col("event_type") == "DEMAND_SPIKE").select(
        "event_id", F.col("supplier_id").alias("signal"),
        F.when(n == 0, "small ring").when(n == 1, "red widget").when(n == 2, "hot gear")
        .otherwise("no such part").alias("product"),
        F.when(F.col("region") == "NA", "AMERICA").when(F.col("region") == "EMEA", "EUROPE")
        .when(F.col("region") == "APAC", "ASIA").otherwise("AFRICA").alias("region"),
        F.timestamp_micros(micros).cast("timestamp_ntz").alias("signal_time"))
    return dev.anchor_as_of(signals, t.silver_orders().select(
        "order_id", "product", "region", "status", "created_at"), F.col("signal_time"))


@query("layer_metrics", "E05 E06", f"""
SELECT 'silver_orders' AS layer, 'row_count' AS metric, count(*)::DOUBLE AS value FROM silver_orders
UNION ALL SELECT 'silver_orders', 'delayed_orders', count(*) FILTER (WHERE delay_days > 0) FROM silver_orders
UNION ALL SELECT 'silver_orders', 'delay_rate_pct', {rnd("count(*) FILTER (WHERE delay_days > 0)::DOUBLE / count(*) * 100", 2)} FROM silver_orders
UNION ALL SELECT 'gold_orders', 'deviations_flagged', count(*) FILTER (WHERE delay_days > 0) FROM silver_orders
UNION ALL SELECT 'gold_orders', 'high_critical_count', count(*) FILTER (WHERE delay_days > 7) FROM silver_orders
UNION ALL SELECT 'supplier_risk', 'supplier_count', count(*) FROM supplier_risk
UNION ALL SELECT 'supplier_risk', 'avg_trust_score', {rnd("sum(CAST(trust_score AS DECIMAL(18,9)))::DOUBLE / count(*)", 3)} FROM supplier_risk
UNION ALL SELECT 'supplier_risk', 'avg_delay_rate', {rnd("sum(CAST(delay_rate_pct AS DECIMAL(18,9)))::DOUBLE / count(*)", 2)} FROM supplier_risk
UNION ALL SELECT 'freight_rates', 'row_count', count(*) FROM freight_silver
UNION ALL SELECT 'freight_rates', 'unique_routes', count(*) FROM (SELECT DISTINCT orig_port, dest_port FROM freight_silver)
UNION ALL SELECT 'freight_rates', 'avg_transit_days', {rnd("sum(transit_days)::DOUBLE / count(*)", 1)} FROM freight_silver
UNION ALL SELECT 'wh_capacities', 'row_count', count(*) FROM wh_silver
UNION ALL SELECT 'wh_capacities', 'total_daily_capacity', sum(daily_capacity) FROM wh_silver
UNION ALL SELECT 'wh_capacities', 'avg_capacity_per_plant', {rnd("sum(daily_capacity)::DOUBLE / count(*)", 1)} FROM wh_silver""")
def layer_metrics(t):
    silver = t.silver_orders()
    late, n = count_if(F.col("delay_days") > 0), F.count("*")

    def mean(c, digits):
        return round_to(ratio(F.sum(F.col(c).cast("decimal(18,9)")), n), digits)

    frames = [
        ops.layer_metrics("silver_orders", silver, n.alias("row_count"), late.alias("delayed_orders"),
                          round_to(ratio(late, n) * 100, 2).alias("delay_rate_pct")),
        ops.layer_metrics("gold_orders", dev.with_delay_flags(silver),
                          F.count("deviation_type").alias("deviations_flagged"),
                          count_if(F.col("severity").isin("HIGH", "CRITICAL")).alias("high_critical_count")),
        ops.layer_metrics("supplier_risk", sup.supplier_risk(silver), n.alias("supplier_count"),
                          mean("trust_score", 3).alias("avg_trust_score"),
                          mean("delay_rate_pct", 2).alias("avg_delay_rate")),
        ops.layer_metrics("freight_rates", freight_silver(t.freight_rates()), n.alias("row_count"),
                          F.countDistinct("orig_port", "dest_port").alias("unique_routes"),
                          mean("transit_days", 1).alias("avg_transit_days")),
        ops.layer_metrics("wh_capacities", warehouse_silver(t.wh_capacities()), n.alias("row_count"),
                          F.sum("daily_capacity").alias("total_daily_capacity"),
                          mean("daily_capacity", 1).alias("avg_capacity_per_plant")),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@query("freshness_age", "E25 J12", """
SELECT 'orders' AS source, CAST(date_diff('second', max(created_at), (SELECT now FROM anchor)) AS BIGINT) AS age_seconds,
       count(*) AS records FROM silver_orders
UNION ALL SELECT 'events', CAST(date_diff('second', max(ts) FILTER (WHERE event_type = 'error'), max(ts)) AS BIGINT), count(*) FROM events""")
def freshness_age(t):
    anchor = F.unix_seconds(t.order_anchor().cast("timestamp"))
    stamp = F.unix_seconds(F.max("created_at").cast("timestamp"))
    orders = t.silver_orders().agg(stamp.alias("newest"), F.count("*").alias("records")).select(
        F.lit("orders").alias("source"), (anchor - F.col("newest")).alias("age_seconds"), "records")
    errors = F.max(F.when(F.col("event_type") == "error", F.col("ts")))
    events = t.base("events").agg(
        F.unix_seconds(errors.cast("timestamp")).alias("newest"),
        F.unix_seconds(F.max("ts").cast("timestamp")).alias("now"), F.count("*").alias("records"),
    ).select(F.lit("events").alias("source"), (F.col("now") - F.col("newest")).alias("age_seconds"), "records")
    return orders.unionByName(events)


@query("dlq_spike", "E25", """
SELECT strftime(day, '%Y-%m-%d') AS day, total, CAST(total - coalesce(lag(total) OVER (ORDER BY day), 0) AS BIGINT) AS new_messages,
       total > coalesce(lag(total) OVER (ORDER BY day), 0) + 10 AS spike
FROM (SELECT CAST(event_time AS DATE) AS day, count(*) AS total FROM validated_events WHERE errors <> '' GROUP BY 1)""")
def dlq_spike(t):
    from harborlight.streaming.validation import with_errors

    return ops.daily_spikes(with_errors(t.stream_events()).filter(F.size("errors") > 0), "event_time")


@query("mttr", "E13", f"""
SELECT count(*) FILTER (WHERE completed_at >= now - INTERVAL 90 DAY) AS total_completed,
       {rnd("coalesce(sum(date_diff('second', d.detected_at, a.completed_at)) FILTER (WHERE completed_at >= now - INTERVAL 90 DAY)::DOUBLE / nullif(count(*) FILTER (WHERE completed_at >= now - INTERVAL 90 DAY), 0) / 60, 0)", 1)} AS mttr_minutes,
       {rnd("coalesce(sum(date_diff('second', d.detected_at, a.created_at))::DOUBLE / nullif(count(*), 0) / 60, 0)", 1)} AS response_minutes
FROM pending_actions a JOIN deviations d ON d.deviation_id = a.deviation_id, anchor WHERE a.status = 'COMPLETED'""")
def mttr(t):
    return ops.mttr(t.pending_actions(), t.deviations(), t.order_anchor() - days(F.lit(90)))


@query("escalation_stats", "E15 E13", f"""
SELECT count(*) FILTER (WHERE status = 'OPEN') AS open_count, count(*) FILTER (WHERE status = 'RESOLVED') AS resolved_count,
       {rnd("sum(epoch(resolved_at)::BIGINT - epoch(created_at)::BIGINT) FILTER (WHERE status = 'RESOLVED')::DOUBLE / count(*) FILTER (WHERE status = 'RESOLVED') / 60", 1)} AS avg_resolve_minutes
FROM escalations""")
def escalation_stats(t):
    return ops.escalation_stats(t.escalations())
