"""Streaming queries. Each equals a batch query over the same events."""

from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.operators import deviations as dev
from harborlight.oracle import TABLES, money
from harborlight.registry import query
from harborlight.session import run_dir
from harborlight.sources import topics
from harborlight.streaming import keyed, late, running, windows, writer
from harborlight.streaming import validation as val


def stream(t):
    return topics.event_stream(t.spark, t.path("events"))


def arriving(t, job, lots=2):
    """The events arrive in lots, up to 20 hours late each, and the job goes on after each; with the last lot comes a clock event. The last result."""
    events, folder, out = t.base("events"), run_dir(t.spark, "arrivals"), None
    arrival = F.unix_seconds(F.col("ts").cast("timestamp")) + F.pmod(F.hash("event_id"), F.lit(72000))
    span = events.agg(F.min(arrival), F.max(arrival)).first()
    lot = F.floor((arrival - span[0]) * lots / (span[1] - span[0] + 1))
    clock = events.limit(1).withColumn("event_type", F.lit("clock")).withColumn("event_id", F.lit(-1).cast("long")).withColumn(
        "ts", F.lit("2100-01-01").cast("timestamp_ntz").cast(dict(events.dtypes)["ts"]))
    for k in range(lots):
        rows = events.filter(lot == k)
        (rows if k < lots - 1 else rows.unionByName(clock)).write.mode("append").parquet(folder)
        out = job(topics.event_stream(t.spark, folder))
    return out


def keyed_orders(events, rows=None):
    """Valid orders for which ``rows`` holds, all without it, and clock events."""
    good = (F.size("errors") == 0) & (F.col("event_type") == "ORDER")
    return keyed.with_clock(val.with_errors(events), good if rows is None else good & rows).drop("errors")


def valid_orders(events):
    return val.valid(windows.orders_only(events))


def plain_time(df, *columns):
    """Times without zone in results, as the event table has them."""
    for c in columns:
        df = df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return df


@query("stream_orders", "I01 A09", """
SELECT event_id, event_time, order_id, supplier_id, region, order_value, delay_days, status
FROM stream_events WHERE event_type = 'ORDER'""")
def stream_orders(t):
    out = running.drain(windows.orders_only(stream(t)).select(
        "event_id", "event_time", "order_id", "supplier_id", "region", "order_value", "delay_days", "status"),
        "orders")
    return plain_time(out, "event_time")


@query("stream_demand", "A10 A09", """
SELECT event_type, event_id, event_time, product, region, forecast_delta_pct, current_inventory_days FROM stream_events""")
def stream_demand(t):
    return plain_time(running.drain(windows.demand_stream(stream(t)), "demand"), "event_time")


@query("stream_demand_spikes", "I05", """
SELECT event_type, event_id, event_time, product, region, forecast_delta_pct, current_inventory_days FROM stream_events
WHERE event_type = 'DEMAND_SPIKE' AND forecast_delta_pct >= 20""")
def stream_demand_spikes(t):
    return plain_time(running.drain(windows.demand_spikes(stream(t)), "spikes"), "event_time")


@query("stream_critical", "I04", """
SELECT event_id, order_id, supplier_id, region, delay_days, status, inventory_level, event_time FROM stream_events
WHERE event_type = 'ORDER' AND delay_days >= 7""")
def stream_critical(t):
    return plain_time(running.drain(windows.critical_delays(stream(t)), "critical"), "event_time")


SUPPLIER_WINDOWS = """
SELECT supplier_id, count(*) AS total_orders, count(*) FILTER (WHERE delay_days > 0) AS delayed_orders,
       count(*) FILTER (WHERE delay_days > 0)::DOUBLE / count(*) AS delay_rate,
       sum(delay_days)::DOUBLE / count(*) AS avg_delay_days, sum(inventory_level) / count(*) AS avg_inventory_level,
       time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start,
       time_bucket(INTERVAL 5 MINUTE, event_time) + INTERVAL 5 MINUTE AS window_end
FROM stream_events WHERE event_type = 'ORDER' GROUP BY supplier_id, window_start"""


def supplier_windows(t):
    out = running.drain_updates(
        windows.supplier_windows(stream(t)), ["supplier_id", "window_start"], "supplier-5m")
    return plain_time(out, "window_start", "window_end")


@query("stream_supplier_5m", "I02", SUPPLIER_WINDOWS)
def stream_supplier_5m(t):
    return supplier_windows(t)


@query("stream_region_5m", "I03", f"""
SELECT region, count(*) AS order_count, {money('order_value')} AS total_order_value,
       {money('order_value')} / count(*) AS avg_order_value, CAST(sum(quantity) AS BIGINT) AS total_quantity,
       time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start,
       time_bucket(INTERVAL 5 MINUTE, event_time) + INTERVAL 5 MINUTE AS window_end
FROM stream_events WHERE event_type = 'ORDER' GROUP BY region, window_start""")
def stream_region_5m(t):
    out = running.drain_updates(windows.region_windows(stream(t)), ["region", "window_start"], "region-5m")
    return plain_time(out, "window_start", "window_end")


@query("latest_windows", "I07", f"SELECT * FROM ({SUPPLIER_WINDOWS}) ORDER BY window_start DESC, supplier_id LIMIT 20")
def latest_windows(t):
    """The newest windows, from the state of a running aggregation; it writes no table."""
    base = run_dir(t.spark, "windows-state")
    running.start_aggregate(windows.supplier_window_sums(stream(t)), base).awaitTermination()
    sums = running.state_rows(t.spark, base, windows.SUPPLIER_WINDOW_STATE)
    out = plain_time(windows.supplier_window_figures(sums), "window_start", "window_end")
    return out.orderBy(F.col("window_start").desc(), "supplier_id").limit(20)


LATE = """event_id % 20 = 0 AND time_bucket(INTERVAL 5 MINUTE, event_time) + INTERVAL 5 MINUTE <= mark"""


@query("stream_late", "I06", f"""
SELECT supplier_id, time_bucket(INTERVAL 5 MINUTE, event_time) AS window_start, count(*) FILTER (WHERE NOT ({LATE})) AS total_orders,
       count(*) FILTER (WHERE {LATE}) AS late_orders, count(*) AS all_orders
FROM stream_events, (SELECT max(event_time) - INTERVAL 24 HOUR AS mark FROM stream_events
                     WHERE event_type = 'ORDER' AND event_id % 20 <> 0)
WHERE event_type = 'ORDER' GROUP BY 1, 2""")
def stream_late(t):
    """One event in twenty arrives after all others; what is over a day late is not counted by the windows and stands in the ledger."""
    base = run_dir(t.spark, "late")
    arrivals, source = f"{base}/arrivals", t.base("events")
    held_back = F.col("event_id") % 20 == 0
    kept = ledger = None
    for part in (source.filter(~held_back), source.filter(held_back)):
        part.write.mode("append").parquet(arrivals)
        events = windows.orders_only(topics.event_stream(t.spark, arrivals))
        kept = running.drain_updates(windows.supplier_windows(events), ["supplier_id", "window_start"], "late", base)
        ledger = late.record(events, f"{base}/ledger")
    window = F.window("event_time", windows.WINDOW)["start"].alias("window_start")
    seen = ledger.groupBy("supplier_id", window).agg(
        F.count("*").alias("all_orders"), F.count(F.when(F.col("late"), 1)).alias("late_orders"))
    out = seen.join(kept.select("supplier_id", "window_start", "total_orders"), ["supplier_id", "window_start"], "left")
    return plain_time(out.select(
        "supplier_id", "window_start", F.coalesce("total_orders", F.lit(0)).alias("total_orders"), "late_orders", "all_orders"), "window_start")


# messages as they come from a topic: JSON text, one in 500 cut off
TABLES["parsed_messages"] = """
SELECT event_id, CASE WHEN event_id % 500 = 499 THEN 'order_id,supplier_id,product,region,quantity,unit_price,order_value,expected_delivery,delay_days,status,inventory_level'
                      ELSE errors END AS errors, event_id % 500 = 499 AS malformed, order_id, order_value, event_type
FROM validated_events"""


def messages(t):
    return val.parse_json(topics.as_messages(stream(t)).withColumnRenamed("event_id", "message_id"))


@query("stream_validate", "I08 A09", """
SELECT event_id AS message_id, errors, errors = '' AS valid FROM parsed_messages""")
def stream_validate(t):
    checked = val.with_errors(messages(t)).select(
        "message_id", F.concat_ws(",", "errors").alias("errors"), (F.size("errors") == 0).alias("valid"))
    return running.drain(checked, "validate")


@query("stream_to_bronze", "I18 A11", """
SELECT event_id, order_id, order_value FROM parsed_messages WHERE errors = '' AND event_type = 'ORDER'""")
def stream_to_bronze(t):
    valid = val.valid(messages(t)).filter(F.col("event_type") == "ORDER")
    return running.drain(valid.select("event_id", "order_id", "order_value"), "bronze")


@query("stream_routed", "I09 A18", """
SELECT CASE WHEN errors <> '' THEN 'dead_letters' WHEN event_type = 'ORDER' THEN 'orders' ELSE 'demand' END AS sink,
       count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS id_sum FROM validated_events GROUP BY 1""")
def stream_routed(t):
    paths = writer.route(stream(t), run_dir(t.spark, "route"))
    out = None
    for name, path in paths.items():
        rows = t.spark.read.parquet(path).groupBy(F.lit(name).alias("sink")).agg(
            F.count("*").alias("rows"), F.sum("event_id").alias("id_sum"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("stream_deviations", "I11 K03", """
SELECT event_id, order_id, type, severity FROM (
  SELECT event_id, order_id, 'DELAY' AS type, CASE WHEN delay_days > 14 THEN 'CRITICAL' WHEN delay_days > 7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM order_events WHERE delay_days > 0
  UNION ALL SELECT event_id, order_id, 'STOCKOUT', CASE WHEN inventory_level < 5 THEN 'HIGH' ELSE 'MEDIUM' END
  FROM order_events WHERE inventory_level < 10
  UNION ALL SELECT event_id, order_id, 'ANOMALY', 'MEDIUM' FROM order_events WHERE order_value > 100000)""")
def stream_deviations(t):
    found = dev.all_matches(val.valid(windows.orders_only(stream(t))), "event_id")
    return running.drain(found.select("event_id", "order_id", "type", "severity"), "deviations")


@query("stream_deviations_batch", "H02 I11", """
SELECT type, severity, count(*) AS n FROM (
  SELECT 'DELAY' AS type, CASE WHEN delay_days > 14 THEN 'CRITICAL' WHEN delay_days > 7 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
  FROM order_events WHERE delay_days > 0
  UNION ALL SELECT 'STOCKOUT', CASE WHEN inventory_level < 5 THEN 'HIGH' ELSE 'MEDIUM' END FROM order_events WHERE inventory_level < 10
  UNION ALL SELECT 'ANOMALY', 'MEDIUM' FROM order_events WHERE order_value > 100000) GROUP BY 1, 2""")
def stream_deviations_batch(t):
    events = val.valid(windows.orders_only(t.stream_events()))
    return dev.all_matches(events).groupBy("type", "severity").agg(F.count("*").alias("n"))


@query("stream_preemptive", "I13", """
SELECT event_id, 'STOCKOUT' AS type, CASE WHEN forecast_delta_pct >= 40 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
       'DEMAND-' || region || '-' || substr(product, 1, 8) AS demand_key
FROM stream_events WHERE event_type = 'DEMAND_SPIKE' AND forecast_delta_pct >= 25 AND current_inventory_days < 7""")
def stream_preemptive(t):
    signals = stream(t).filter(F.col("event_type") == "DEMAND_SPIKE")
    return running.drain(
        dev.preemptive_stockouts(signals).select("event_id", "type", "severity", "demand_key"), "preemptive")


@query("stream_supplier_stats", "I14 E17", """
SELECT supplier_id, count(*) AS total_orders, count(*) FILTER (WHERE delay_days > 0) AS delayed_orders,
       sum(delay_days)::DOUBLE / count(*) AS avg_delay_days,
       greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (count(*) FILTER (WHERE delay_days > 0)::DOUBLE / greatest(count(*), 1)::DOUBLE) * 0.5::DOUBLE)) AS trust_score
FROM order_events GROUP BY 1""")
def stream_supplier_stats(t):
    """Sums in Spark's state, read from there."""
    base = run_dir(t.spark, "stats")
    sums = windows.supplier_sums(val.valid(windows.orders_only(stream(t))))
    running.start_aggregate(sums, base).awaitTermination()
    return windows.supplier_figures(running.state_rows(t.spark, base, windows.SUPPLIER_STATE))


@query("stream_idempotent", "I17", "SELECT event_id, event_time, order_id, status FROM stream_events")
def stream_idempotent(t):
    """Every event is delivered twice."""
    twice = stream(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    out = running.drain(windows.once(twice).select("event_id", "event_time", "order_id", "status"), "once")
    return plain_time(out, "event_time")


HEALTH = """
WITH RECURSIVE seq AS (
  SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY event_time, event_id) AS i,
         delay_days > 14 OR inventory_level < 5 AS bad FROM order_events),
walk AS (
  SELECT supplier_id, 0::BIGINT AS i, 0::BIGINT AS c, 'NORMAL' AS h FROM seq GROUP BY 1
  UNION ALL
  SELECT s.supplier_id, s.i, CASE WHEN s.bad THEN w.c + 1 ELSE greatest(0, w.c - 1) END,
    CASE WHEN s.bad AND w.h = 'NORMAL' AND w.c + 1 >= 2 THEN 'DEGRADING'
         WHEN s.bad AND w.h = 'DEGRADING' AND w.c + 1 >= 5 THEN 'CRITICAL'
         WHEN NOT s.bad AND w.h = 'CRITICAL' AND greatest(0, w.c - 1) < 3 THEN 'DEGRADING'
         WHEN NOT s.bad AND w.h = 'DEGRADING' AND greatest(0, w.c - 1) = 0 THEN 'NORMAL' ELSE w.h END
  FROM walk w JOIN seq s ON s.supplier_id = w.supplier_id AND s.i = w.i + 1)
SELECT s.event_id, s.supplier_id, w.c AS anomaly_count, w.h AS health FROM seq s JOIN walk w ON w.supplier_id = s.supplier_id AND w.i = s.i"""


@query("stream_health", "I15", HEALTH)
def stream_health(t):
    base = run_dir(t.spark, "health")
    return arriving(t, lambda events: running.drain(keyed.health(keyed_orders(events)), "health", base)).select(
        "event_id", "supplier_id", "anomaly_count", "health")


SUPPRESS = """
WITH RECURSIVE seq AS (
  SELECT event_id, supplier_id, CAST(floor(epoch(event_time)) AS BIGINT) AS at,
         row_number() OVER (PARTITION BY supplier_id ORDER BY floor(epoch(event_time)), event_id) AS i
  FROM order_events WHERE delay_days > 14),
walk AS (
  SELECT supplier_id, 0::BIGINT AS i, false AS passed, []::BIGINT[] AS kept FROM seq GROUP BY 1
  UNION ALL
  SELECT s.supplier_id, s.i, len(list_filter(w.kept, lambda a: a >= s.at - 86400)) < 5,
    CASE WHEN len(list_filter(w.kept, lambda a: a >= s.at - 86400)) < 5
         THEN list_append(list_filter(w.kept, lambda a: a >= s.at - 86400), s.at)
         ELSE list_filter(w.kept, lambda a: a >= s.at - 86400) END
  FROM walk w JOIN seq s ON s.supplier_id = w.supplier_id AND s.i = w.i + 1)
SELECT s.supplier_id, s.event_id, s.at FROM seq s JOIN walk w ON w.supplier_id = s.supplier_id AND w.i = s.i WHERE w.passed"""


@query("stream_suppress", "I12", SUPPRESS)
def stream_suppress(t):
    base, critical = run_dir(t.spark, "suppress"), rules.delay_severity(F.col("delay_days")) == "CRITICAL"
    return arriving(t, lambda events: running.drain(keyed.accepted_alerts(keyed_orders(events, critical)), "suppress", base))


@query("stream_causality", "I16", """
SELECT event_id, supplier_id, event_time, delay_event, 'DELAY→STOCKOUT (supplier ' || supplier_id || ')' AS causality_chain
FROM (SELECT *, max(CASE WHEN delay_days > 7 THEN event_time END) OVER w AS delay_time,
             last_value(CASE WHEN delay_days > 7 THEN event_id END IGNORE NULLS) OVER w AS delay_event
      FROM order_events WINDOW w AS (PARTITION BY supplier_id ORDER BY event_time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
WHERE inventory_level < 10 AND floor(epoch(event_time)) - floor(epoch(delay_time)) <= 7200""")
def stream_causality(t):
    base = run_dir(t.spark, "causes")
    return plain_time(arriving(t, lambda events: running.drain(keyed.causes(keyed_orders(events)), "causes", base)), "event_time")


@query("stream_causality_join", "I16", """
SELECT DISTINCT s.event_id, s.supplier_id, s.event_time, time_bucket(INTERVAL 1 HOUR, d.event_time) AS cause_hour
FROM stream_events s JOIN (SELECT * FROM stream_events WHERE event_type = 'ORDER' AND delay_days > 7) d
  ON d.supplier_id = s.supplier_id AND d.event_time BETWEEN s.event_time - INTERVAL 2 HOUR AND s.event_time
WHERE s.event_type = 'ORDER' AND s.inventory_level < 10""")
def stream_causality_join(t):
    base = run_dir(t.spark, "cause-join")
    out = arriving(t, lambda events: running.drain(windows.stockouts_after_delays(events), "cause-join", base), lots=1)
    return plain_time(out, "event_time", "cause_hour")


SUPPRESS_WALK, SUPPRESS_PASSED = SUPPRESS.rsplit("SELECT s.supplier_id, s.event_id, s.at", 1)


@query("stream_process_batch", "I10 A15 A17 F05 I12", f"""{SUPPRESS_WALK.rstrip()},
passed AS (SELECT s.event_id {SUPPRESS_PASSED})
SELECT o.order_id, o.status, o.delay_days, o.inventory_level, v.versions, s.total_orders AS supplier_orders,
       coalesce(d.deviations, 0) AS deviations
FROM (SELECT * FROM order_events QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY event_time DESC, event_id DESC) = 1) o
JOIN (SELECT order_id, count(*) AS versions FROM order_events GROUP BY 1) v ON v.order_id = o.order_id
JOIN (SELECT supplier_id, count(*) AS total_orders FROM order_events GROUP BY 1) s ON s.supplier_id = o.supplier_id
LEFT JOIN (SELECT order_id, sum((delay_days > 0 AND delay_days <= 14)::INT + (inventory_level < 10)::INT + (order_value > 100000)::INT
                + (event_id IN (SELECT event_id FROM passed))::INT)::BIGINT AS deviations
           FROM order_events GROUP BY 1) d ON d.order_id = o.order_id""")
def stream_process_batch(t):
    """The full writer over the stream; the result reads back the tables and the state it keeps, accepted alerts among the deviations."""
    w = writer.OrderWriter(t.spark, run_dir(t.spark, "process"))
    arriving(t, w.run)
    versions = w.order_events().groupBy("order_id").agg(F.max("aggregate_version").alias("versions"))
    suppliers = w.suppliers().select("supplier_id", F.col("total_orders").alias("supplier_orders"))
    found = w.deviations().groupBy("order_id").agg(F.count("*").alias("deviations"))
    return w.orders().join(versions, "order_id").join(suppliers, "supplier_id").join(found, "order_id", "left").select(
        "order_id", "status", "delay_days", "inventory_level", "versions", "supplier_orders",
        F.coalesce("deviations", F.lit(0)).alias("deviations"))
