"""Event history, audit, lineage, network and feature queries."""

from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.functions.numeric import round_to
from harborlight.operators import features as feat
from harborlight.operators import graph
from harborlight.operators import history as ops
from harborlight.operators import orders as ord_ops
from harborlight.oracle import TABLES, rnd
from harborlight.registry import query
from harborlight.streaming.validation import valid

LOG = ["event_id", "event_time", "order_id", "supplier_id", "region", "event_type", "old_status",
       "new_status", "old_delay_days", "new_delay_days", "aggregate_version"]


def order_log(t):
    return ops.order_log(valid(t.stream_events().filter(F.col("event_type") == "ORDER")))


@query("order_event_log", "F05", f"SELECT {', '.join(LOG)} FROM order_log")
def order_event_log(t):
    return order_log(t)


@query("order_transitions", "F06", "SELECT event_type, count(*) AS n FROM order_log GROUP BY 1")
def order_transitions(t):
    return order_log(t).groupBy("event_type").agg(F.count("*").alias("n"))


@query("replay_state", "F07", """
SELECT order_id, arg_max(new_status, aggregate_version) AS status, arg_max(new_delay_days, aggregate_version) AS delay_days,
       max(aggregate_version) AS version FROM order_log WHERE aggregate_version <= 3 GROUP BY 1""")
def replay_state(t):
    return ops.state_at(order_log(t), 3)


@query("order_history", "F08 L04", """
SELECT event_id, event_type, old_status, new_status, aggregate_version FROM order_log
WHERE order_id = 'EV-15-6' ORDER BY aggregate_version LIMIT 20 OFFSET 1""")
def order_history(t):
    return ord_ops.listing(order_log(t), [F.col("aggregate_version").asc()], 20, 1, order_id="EV-15-6").select(
        "event_id", "event_type", "old_status", "new_status", "aggregate_version")


@query("recent_events", "L04", """
SELECT event_id, event_time, order_id, event_type FROM order_log WHERE event_type = 'STATUS_CHANGED'
ORDER BY event_time DESC, event_id DESC LIMIT 50""")
def recent_events(t):
    return ord_ops.listing(
        order_log(t).select("event_id", "event_time", "order_id", "event_type"),
        [F.col("event_time").desc(), F.col("event_id").desc()], 50, event_type="STATUS_CHANGED")


@query("audit_chain", "F11", f"""
SELECT prev_hash, count(*) AS children, min(id) AS first_child,
       prev_hash <> repeat('0', 64) AND NOT bool_or(o IS NOT NULL AND o < id) AS broken, count(*) > 1 AS fork
FROM (SELECT l.id, l.prev_hash, k.id AS o FROM audit_log l LEFT JOIN audit_log k ON k.row_hash = l.prev_hash)
GROUP BY 1 HAVING broken OR fork""")
def audit_chain(t):
    return ops.audit_findings(t.audit_log())


@query("lineage_graph", "L02 H03", """
SELECT DISTINCT input_1 AS source, job_name AS target FROM lineage_events WHERE event_type = 'COMPLETE'
UNION SELECT input_2, job_name FROM lineage_events WHERE event_type = 'COMPLETE'
UNION SELECT job_name, output FROM lineage_events WHERE event_type = 'COMPLETE'""")
def lineage_graph(t):
    return ops.lineage_edges(t.lineage_events())


@query("lineage_nodes", "L02 H03", """
SELECT job_name AS id, 'job' AS type FROM lineage_events WHERE event_type = 'COMPLETE'
UNION SELECT input_1, 'dataset' FROM lineage_events WHERE event_type = 'COMPLETE'
UNION SELECT input_2, 'dataset' FROM lineage_events WHERE event_type = 'COMPLETE'
UNION SELECT output, 'dataset' FROM lineage_events WHERE event_type = 'COMPLETE'""")
def lineage_nodes(t):
    return ops.lineage_nodes(t.lineage_events())


@query("lineage_jobs", "F02 L03", """
SELECT job_name, event_type AS last_status, created_at AS last_run FROM lineage_events
QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY created_at DESC, run_id DESC) = 1""")
def lineage_jobs(t):
    return ops.latest_runs(t.lineage_events())


@query("lineage_listing", "L04", """
SELECT run_id, job_name, event_type, output, created_at FROM lineage_events WHERE job_name = 'job-8'
ORDER BY created_at DESC, run_id DESC LIMIT 50 OFFSET 10""")
def lineage_listing(t):
    return ord_ops.listing(
        t.lineage_events().drop("inputs"), [F.col("created_at").desc(), F.col("run_id").desc()], 50, 10,
        job_name="job-8")


# -- network --------------------------------------------------------------

TABLES["net_edges"] = "SELECT DISTINCT 'plant:' || plant_code AS source, 'port:' || port AS target FROM plant_ports"
TABLES["layer_edges"] = """
SELECT source, target FROM net_edges UNION
SELECT 'port:' || n_name, 'region:' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey"""
TABLES["layer_degrees"] = """
SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (
  SELECT source AS id, 0 AS i, 1 AS o FROM layer_edges UNION ALL SELECT target, 1, 0 FROM layer_edges) GROUP BY 1"""
TABLES["layer_paths"] = """
SELECT a.source AS s, a.target AS b, c.target AS t FROM layer_edges a JOIN layer_edges c ON a.target = c.source"""
# paths have at most two steps here, so a middle node's share is one over the number of parallel paths
TABLES["layer_between"] = """
SELECT d.id, d.in_degree, d.out_degree, coalesce(x.share, 0.0::DOUBLE) / ((n - 1) * (n - 2))::DOUBLE AS bc, n
FROM layer_degrees d CROSS JOIN (SELECT count(*) AS n FROM layer_degrees) c
LEFT JOIN (SELECT b, sum(1.0::DOUBLE / p) AS share FROM (
    SELECT b, count(*) OVER (PARTITION BY s, t) AS p FROM layer_paths) GROUP BY 1) x ON x.b = d.id"""


def layered(t):
    regions = t.port_regions().select(
        F.concat(F.lit("port:"), "port").alias("source"), F.concat(F.lit("region:"), "region").alias("target"))
    return graph.edges(t.plant_ports()).unionByName(regions)


@query("network_graph", "K14 H03", """
SELECT 'edge' AS kind, source AS id, target, 'ships_via' AS label FROM net_edges
UNION ALL SELECT 'node', id, NULL, substr(id, instr(id, ':') + 1)
FROM (SELECT source AS id FROM net_edges UNION SELECT target FROM net_edges)""")
def network_graph(t):
    edges = graph.edges(t.plant_ports())
    return edges.select(
        F.lit("edge").alias("kind"), F.col("source").alias("id"), "target", F.lit("ships_via").alias("label")
    ).unionByName(graph.nodes(edges).select(
        F.lit("node").alias("kind"), "id", F.lit(None).cast("string").alias("target"), "label"))


@query("network_stats", "K14", """
SELECT (SELECT count(DISTINCT source) FROM net_edges) AS plant_count,
       (SELECT count(DISTINCT target) FROM net_edges) AS port_count, (SELECT count(*) FROM net_edges) AS edge_count""")
def network_stats(t):
    return graph.edges(t.plant_ports()).agg(
        F.countDistinct("source").alias("plant_count"), F.countDistinct("target").alias("port_count"),
        F.count("*").alias("edge_count"))


@query("plant_products", "D17", """
SELECT 'plant:' || n.plant_code AS id, n.plant_code AS label, coalesce(p.products, '') AS products, coalesce(p.listed, 0) AS listed
FROM (SELECT DISTINCT plant_code FROM plant_ports) n LEFT JOIN (
  SELECT plant_code, string_agg(product_id, ',' ORDER BY product_id) AS products, count(*) AS listed
  FROM (SELECT * FROM products_per_plant QUALIFY row_number() OVER (PARTITION BY plant_code ORDER BY product_id) <= 10)
  GROUP BY 1) p ON p.plant_code = n.plant_code""")
def plant_products(t):
    return graph.plant_products(graph.nodes(graph.edges(t.plant_ports())), t.products_per_plant())


@query("network_degree", "K15", f"""
SELECT id, in_degree, out_degree, {rnd('(in_degree + out_degree)::DOUBLE / (n - 1)', 4)} AS degree,
       in_degree::DOUBLE AS cascade_fallback, {rnd('m::DOUBLE / (n * (n - 1))::DOUBLE', 6)} AS density
FROM layer_degrees, (SELECT count(*) AS n FROM layer_degrees), (SELECT count(*) AS m FROM layer_edges)""")
def network_degree(t):
    return graph.degree_risk(layered(t))


BETWEEN = f"""
SELECT id, {rnd('bc', 4)} AS betweenness, {rnd('(in_degree + out_degree)::DOUBLE / (n - 1)', 4)} AS degree,
       {rnd('bc * in_degree', 4)} AS cascade_risk FROM layer_between"""


@query("network_betweenness", "K16", BETWEEN)
def network_betweenness(t):
    return graph.cascade_risk(layered(t))


LOOSE, LOOSE_RISK = 0.25, 0.01
TABLES["layer_pivots"] = f"""
SELECT id, k, n FROM (SELECT id, row_number() OVER (ORDER BY md5(id), id) AS i FROM layer_degrees),
  (SELECT n, least(n, ceil(ln(2 * n / {LOOSE_RISK}::DOUBLE) / (2 * {LOOSE} * {LOOSE})::DOUBLE * power(n / (n - 1)::DOUBLE, 2))) AS k
   FROM (SELECT count(*)::DOUBLE AS n FROM layer_degrees)) WHERE i <= k"""


@query("network_sampled", "K16", f"""
SELECT d.id, {rnd('coalesce(x.share, 0.0::DOUBLE) * (c.n / c.k) / ((c.n - 1) * (c.n - 2))', 4)} AS betweenness
FROM layer_degrees d, (SELECT any_value(n) AS n, any_value(k) AS k FROM layer_pivots) c
LEFT JOIN (SELECT b, sum(1.0::DOUBLE / p) AS share FROM (
    SELECT b, s, count(*) OVER (PARTITION BY s, t) AS p FROM layer_paths) WHERE s IN (SELECT id FROM layer_pivots) GROUP BY 1) x ON x.b = d.id""")
def network_sampled(t):
    """Betweenness from as many pivots as a wide bound asks for."""
    return graph.sampled_betweenness(layered(t), LOOSE, LOOSE_RISK).select("id", round_to("betweenness", 4).alias("betweenness"))


@query("network_risk", "G04", f"SELECT * FROM ({BETWEEN}) ORDER BY cascade_risk DESC, id LIMIT 20")
def network_risk(t):
    return graph.cascade_risk(layered(t)).orderBy(F.col("cascade_risk").desc(), "id").limit(20)


# -- features -------------------------------------------------------------

# Declared features; the names and expressions are data, not code.
FEATURES = {
    "value_per_piece": "try_divide(order_value, quantity)",
    "late_value": "delay_days * order_value",
    "stock_gap": "100 - inventory_level",
    "is_bulk": "CASE WHEN quantity > 40 THEN 1 ELSE 0 END",
    "constant": "1.0",
    "sparse": "CASE WHEN quantity > 25 THEN quantity END",
    "huge": "order_value * 1000000000000",
    "value_twin": "order_value * 2 + 1",
}
NUMERIC = ["quantity", "unit_price", "order_value", "delay_days", "inventory_level"]
F_SQL = {
    "value_per_piece": "order_value / quantity",
    "late_value": "delay_days * order_value",
    "stock_gap": "100 - inventory_level",
    "is_bulk": "CASE WHEN quantity > 40 THEN 1 ELSE 0 END",
    "constant": "1.0",
    "sparse": "CASE WHEN quantity > 25 THEN quantity END",
    "huge": "order_value * 1000000000000",
    "value_twin": "order_value * 2 + 1",
}


@query("column_profile", "E21", " UNION ALL ".join(
    f"SELECT '{c}' AS column, {rnd(f'sum(CAST({c} AS DECIMAL(18,2)))::DOUBLE / count({c})', 4)} AS mean, "
    f"{rnd(f'stddev_samp({c}::DOUBLE)', 3)} AS std, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, "
    f"{rnd(f'(count(*) - count({c}))::DOUBLE / count(*)', 4)} AS null_pct FROM raw_orders" for c in NUMERIC))
def column_profile(t):
    return feat.profile(t.bronze_orders(*NUMERIC), NUMERIC)


@query("computed_features", "K17", "SELECT order_id, " + ", ".join(
    f"({e})::DOUBLE AS {n}" for n, e in F_SQL.items()) + " FROM silver_orders")
def computed_features(t):
    return feat.compute(t.silver_orders(), FEATURES)


@query("feature_merge", "D07", """
SELECT o.order_id, o.delay_days, (o.order_value / o.quantity)::DOUBLE AS value_per_piece,
       (100 - o.inventory_level)::DOUBLE AS stock_gap FROM silver_orders o""")
def feature_merge(t):
    silver = t.silver_orders()
    computed = feat.compute(silver, {k: FEATURES[k] for k in ("value_per_piece", "stock_gap")})
    return feat.merge(silver.select("order_id", "delay_days"), computed)


def _gate_sql():
    parts = []
    for n, e in F_SQL.items():
        f = f"({e})::DOUBLE"
        corr = "[" + ", ".join(
            f"{{'r': abs(corr({f}, {c}::DOUBLE)), 'name': '{c}'}}" for c in NUMERIC) + "]"
        parts.append(f"""SELECT '{n}' AS feature, count(*) FILTER (WHERE {f} IS NULL)::DOUBLE / count(*) AS nulls,
  max(abs({f})) AS top, coalesce(stddev_samp({f}), 0.0::DOUBLE) AS sd, {corr} AS corrs FROM silver_orders""")
    union = " UNION ALL ".join(parts)
    return f"""
SELECT feature, {rnd('nulls', 4)} AS null_ratio, false AS has_inf, {rnd('top', 2)} AS max_abs, CASE WHEN top < 1e10 THEN {rnd('sd', 3)} END AS std,
       {rnd('r', 4)} AS max_corr, name AS corr_with,
       CASE WHEN nulls >= 0.05 THEN 'nulls' WHEN top >= 1e10 THEN 'distribution' WHEN sd <= 0.001 THEN 'variance'
            WHEN r >= 0.99 THEN 'novelty' END AS failed_gate,
       NOT (nulls >= 0.05 OR top >= 1e10 OR sd <= 0.001 OR r >= 0.99) AS passed
FROM (SELECT *, coalesce(best.r, 0.0::DOUBLE) AS r, best.name AS name FROM (
   SELECT *, list_sort(list_filter(corrs, lambda c: c.r IS NOT NULL AND NOT isnan(c.r)), 'DESC')[1] AS best FROM ({union})))"""


GATES = _gate_sql()


@query("feature_gates", "K18", GATES)
def feature_gates(t):
    return feat.gates(t.silver_orders(), FEATURES, NUMERIC)


@query("label_encode", "K08", """
SELECT o.order_id, CAST(s.code AS BIGINT) AS supplier_id_enc, CAST(r.code AS BIGINT) AS region_enc FROM silver_orders o
JOIN (SELECT supplier_id, dense_rank() OVER (ORDER BY supplier_id) - 1 AS code FROM (SELECT DISTINCT supplier_id FROM silver_orders)) s
  ON s.supplier_id = o.supplier_id
JOIN (SELECT region, dense_rank() OVER (ORDER BY region) - 1 AS code FROM (SELECT DISTINCT region FROM silver_orders)) r
  ON r.region = o.region""")
def label_encode(t):
    return feat.encode(t.silver_orders().select("order_id", "supplier_id", "region"), ["supplier_id", "region"]).select(
        "order_id", "supplier_id_enc", "region_enc")


@query("score_drift", "F12", f"""
SELECT month, CAST(n AS BIGINT) AS rows, auc AS roc_auc, {rnd('lag(auc) OVER (ORDER BY month) - auc', 4)} AS drop_vs_previous,
       {rnd('first_value(auc IGNORE NULLS) OVER (ORDER BY month) - auc', 4)} AS drop_vs_first,
       coalesce({rnd('first_value(auc IGNORE NULLS) OVER (ORDER BY month) - auc', 4)} > 0.05, false) AS retrain,
       CASE WHEN auc IS NULL OR auc < 0.6 THEN 'BELOW_FLOOR' WHEN n < 100 THEN 'TOO_FEW_ROWS'
            WHEN auc <= lag(auc) OVER (ORDER BY month) THEN 'NOT_BETTER' ELSE 'CANDIDATE' END AS promotion
FROM (SELECT month, n, {rnd('(rank_sum - p * (p + 1) / 2.0::DOUBLE) / nullif(p::DOUBLE * (n - p), 0)', 4)} AS auc
  FROM (SELECT month, count(*) AS n, count(*) FILTER (WHERE late) AS p, sum(avg_rank) FILTER (WHERE late) AS rank_sum
    FROM (SELECT month, late, rank() OVER (PARTITION BY month ORDER BY score)
                 + (count(*) OVER (PARTITION BY month, score) - 1) / 2.0::DOUBLE AS avg_rank
      FROM (SELECT strftime(created_at, '%Y-%m') AS month, delay_days > 0 AS late,
              {rnd('least(CASE WHEN inventory_level < 100 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN order_value > 10000 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN quantity > 500 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 0.95::DOUBLE)', 4)} AS score
            FROM silver_orders)) GROUP BY 1))""")
def score_drift(t):
    scored = t.silver_orders().select(
        F.date_format("created_at", "yyyy-MM").alias("month"), (F.col("delay_days") > 0).alias("late"),
        rules.heuristic_probability(F.col("inventory_level"), F.col("order_value"), F.col("quantity")).alias("score"))
    return feat.drift(feat.auc_by_period(scored, "month", "score", "late"), "month")
