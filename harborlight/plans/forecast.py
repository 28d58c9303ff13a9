"""Freight, risk and demand forecast queries."""

from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.functions.numeric import count_if, ratio, round_to
from harborlight.operators import forecast as ops
from harborlight.operators.freight import cheapest_carrier, freight_silver, warehouse_silver
from harborlight.oracle import TABLES, money, rnd
from harborlight.registry import query


@query("freight_silver", "B12", "SELECT * FROM freight_silver")
def freight(t):
    return freight_silver(t.freight_rates())


@query("wh_silver", "B13", "SELECT * FROM wh_silver")
def warehouses(t):
    return warehouse_silver(t.wh_capacities())


TABLES["cheapest"] = """
SELECT dest_port, carrier AS alt_carrier, min_cost AS alt_min_cost, transit_days AS alt_transit_days
FROM freight_silver QUALIFY row_number() OVER (PARTITION BY dest_port ORDER BY min_cost, carrier, orig_port) = 1"""


@query("cheapest_carrier", "F04", "SELECT * FROM cheapest")
def cheapest(t):
    return cheapest_carrier(freight_silver(t.freight_rates()))


TABLES["decay_risk"] = f"""
SELECT supplier_id, total_orders, {rnd('late / greatest(weight, 1e-9::DOUBLE)', 6)} AS delay_probability,
       delays::DOUBLE / total_orders AS avg_delay_days,
       {rnd('greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - 1 / sqrt(total_orders::DOUBLE)))', 3)} AS confidence
FROM (SELECT supplier_id, count(*) AS total_orders, sum(w) AS weight,
             sum(CASE WHEN delay_days > 0 THEN w ELSE 0 END) AS late, sum(delay_days) AS delays
      FROM (SELECT *, exp(-CASE WHEN expected_delivery IS NULL THEN 180.0::DOUBLE
                       ELSE greatest(date_diff('second', expected_delivery, now) / 86400.0::DOUBLE, 0.0::DOUBLE) END / 90.0::DOUBLE) AS w
            FROM silver_orders, anchor) GROUP BY 1)"""


@query("decay_risk", "E02", "SELECT * FROM decay_risk")
def decay_risk(t):
    return ops.decay_risk(t.silver_orders(), t.order_anchor())


TABLES["all_risks"] = f"""
SELECT o.order_id, o.supplier_id, o.product, o.region, o.quantity, o.order_value, o.expected_delivery, r.delay_probability,
       r.confidence, {rnd("date_diff('second', now, o.expected_delivery) / 86400.0::DOUBLE", 2)} AS days_to_delivery,
       {rnd('o.order_value * r.delay_probability', 2)} AS risk_score
FROM silver_orders o JOIN decay_risk r ON r.supplier_id = o.supplier_id, anchor
WHERE o.status <> 'DELIVERED' AND r.delay_probability > 0.15"""

TABLES["forecasted"] = """
SELECT f.*, 'Supplier ' || f.supplier_id || ': ' || CAST(floor(delay_probability * 100 + 0.5) AS BIGINT)
         || '% weighted delay prob (confidence ' || CAST(floor(confidence * 100 + 0.5) AS BIGINT)
         || '%), risk_score=' || CAST(floor(risk_score + 0.5) AS BIGINT) AS risk_reason,
       c.alt_carrier, c.alt_min_cost, c.alt_transit_days, w.daily_capacity
FROM all_risks f LEFT JOIN cheapest c ON c.dest_port = f.region LEFT JOIN wh_silver w ON w.plant_code = f.supplier_id"""


def risks(t):
    orders = t.silver_orders().select(
        "order_id", "supplier_id", "product", "region", "quantity", "order_value", "expected_delivery",
        "status", "delay_days")
    risk = ops.decay_risk(orders, t.order_anchor())
    return ops.at_risk_orders(orders, risk, t.order_anchor()).drop("status", "delay_days", "avg_delay_days")


def forecasted(t):
    return ops.enrich_risks(
        risks(t).withColumn("risk_reason", ops.risk_reason()),
        freight_silver(t.freight_rates()), warehouse_silver(t.wh_capacities()))


@query("forecasted_risks", "K04 G01 E02", 
"SELECT * FROM all_risks ORDER BY risk_score DESC, order_id LIMIT 500")
def forecasted_risks(t):
    """The report of the 500 highest values at risk."""
    return ops.top_risks(risks(t))


@query("risk_enriched", "D03 F04 B19", "SELECT * FROM forecasted")
def risk_enriched(t):
    return forecasted(t)


@query("at_risk_list", "G02", """
SELECT order_id, risk_score FROM all_risks WHERE risk_score >= 15000 ORDER BY risk_score DESC, order_id LIMIT 50""")
def at_risk_list(t):
    return risks(t).filter(F.col("risk_score") >= 15000).orderBy(
        F.col("risk_score").desc(), "order_id").limit(50).select("order_id", "risk_score")


@query("forecast_summary", "E18", f"""
SELECT count(*) AS at_risk_count, count(DISTINCT supplier_id) AS suppliers_affected,
       {rnd('sum(CAST(days_to_delivery AS DECIMAL(18,2)))::DOUBLE / count(*)', 1)} AS avg_days_to_delivery FROM all_risks""")
def forecast_summary(t):
    return risks(t).agg(
        F.count("*").alias("at_risk_count"), F.countDistinct("supplier_id").alias("suppliers_affected"),
        round_to(ratio(F.sum(F.col("days_to_delivery").cast("decimal(18,2)")), F.count("*")), 1)
        .alias("avg_days_to_delivery"))


# Columns the serving side shows, where the gold table has them.
SERVED = [
    "order_id", "supplier_id", "days_to_delivery", "risk_score", "delay_probability", "confidence",
    "risk_reason", "alt_carrier", "alt_min_cost", "alt_transit_days", "product", "quantity",
    "order_value", "expected_delivery",
]

# our own test value: a column that the gold table does not have
NOT_IN_GOLD = ["forecast_note"]


@query("serving_forecast", "A20", """
SELECT order_id, supplier_id, days_to_delivery, risk_score, delay_probability, confidence, risk_reason,
       coalesce(alt_carrier, '') AS alt_carrier, alt_min_cost, alt_transit_days, product, quantity, order_value,
       strftime(expected_delivery, '%Y-%m-%dT%H:%M:%SZ') AS expected_delivery FROM forecasted""")
def serving_forecast(t):
    """The shown columns the gold table has; empty text for null, ISO text for times."""
    gold = forecasted(t)
    kinds = dict(gold.dtypes)

    def shown(c):
        if kinds[c].startswith("timestamp"):
            return F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("")).alias(c)
        return F.coalesce(F.col(c), F.lit("")).alias(c) if kinds[c] == "string" else F.col(c)

    return gold.select(*[shown(c) for c in SERVED + NOT_IN_GOLD if c in kinds])


@query("delay_predictions", "K05 D08", f"""
SELECT order_id, supplier_id, supplier_name, order_value, status, CAST(left_days AS INTEGER) AS days_remaining,
       left_days < 0 AS is_overdue, {rnd('p', 3)} AS delay_probability,
       CASE WHEN p >= 0.75 THEN 'CRITICAL' WHEN p >= 0.5 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level,
       {rnd('trust', 3)} AS supplier_trust, {rnd('delay', 1)} AS supplier_avg_delay_days
FROM (SELECT *, least(0.99::DOUBLE, greatest(0.05::DOUBLE, least(0.95::DOUBLE, 1 - trust)) * least(2.0::DOUBLE, 1 + delay / 14.0::DOUBLE)
         * CASE WHEN left_days < 0 THEN 2.0::DOUBLE WHEN left_days <= 3 THEN 1.5::DOUBLE WHEN left_days <= 7 THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) AS p
      FROM (SELECT o.order_id, o.supplier_id, coalesce(s.name, o.supplier_id) AS supplier_name, o.order_value, o.status,
              floor(date_diff('second', now, o.expected_delivery) / 86400.0::DOUBLE) AS left_days,
              CASE WHEN s.supplier_id IS NULL THEN 0.7::DOUBLE ELSE coalesce(s.trust_score, 1.0::DOUBLE) END AS trust,
              coalesce(s.avg_delay_days, 0.0::DOUBLE) AS delay
            FROM (SELECT order_id, supplier_id, order_value, status, expected_delivery FROM silver_orders UNION ALL
                  SELECT 'GONE-' || order_id, 'GONE-' || supplier_id, order_value, status, expected_delivery FROM silver_orders
                  WHERE inventory_level < 2) o LEFT JOIN suppliers s ON s.supplier_id = o.supplier_id, anchor
            WHERE o.status NOT IN ('DELIVERED', 'CANCELLED')))
WHERE p >= 0.3""")
def delay_predictions(t):
    """All orders, and added ones of suppliers that the master table does not have, to meet the default trust."""
    columns = ["order_id", "supplier_id", "order_value", "status", "expected_delivery"]
    silver = t.silver_orders().select(*columns, "inventory_level")
    gone = [F.concat(F.lit("GONE-"), F.col(c)).alias(c) for c in columns[:2]]
    added = silver.filter(F.col("inventory_level") < 2).select(*gone, *columns[2:])
    scored = ops.delay_predictions(silver.select(columns).unionByName(added), t.suppliers(), t.order_anchor())
    return scored.filter(F.col("raw_probability") >= 0.3).drop("raw_probability")


@query("heuristic_predict", "K06", f"""
SELECT order_id, p AS probability, p >= 0.35 AS is_delayed, 'LOW' AS confidence
FROM (SELECT order_id, {rnd('least(CASE WHEN inventory_level < 100 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN order_value > 10000 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN quantity > 500 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END, 0.95::DOUBLE)', 4)} AS p
      FROM silver_orders)""")
def heuristic_predict(t):
    p = rules.heuristic_probability(F.col("inventory_level"), F.col("order_value"), F.col("quantity"))
    return t.silver_orders().select(
        "order_id", p.alias("probability"), (p >= 0.35).alias("is_delayed"), F.lit("LOW").alias("confidence"))


@query("heuristic_baseline", "K07", f"""
SELECT {rnd('greatest(r, 1 - r)', 4)} AS accuracy, 0.5::DOUBLE AS roc_auc, 0.0::DOUBLE AS precision, 0.0::DOUBLE AS recall,
       n AS train_rows, 0 AS test_rows
FROM (SELECT count(*) FILTER (WHERE delay_days > 0)::DOUBLE / count(*) AS r, count(*) AS n FROM silver_orders)""")
def heuristic_baseline(t):
    rate = ratio(count_if(F.col("delay_days") > 0), F.count("*"))
    return t.silver_orders().agg(rate.alias("r"), F.count("*").alias("n")).select(
        round_to(F.greatest(F.col("r"), 1 - F.col("r")), 4).alias("accuracy"), F.lit(0.5).alias("roc_auc"),
        F.lit(0.0).alias("precision"), F.lit(0.0).alias("recall"), F.col("n").alias("train_rows"),
        F.lit(0).alias("test_rows"))


TABLES["daily_value"] = f"""
SELECT CAST(expected_delivery AS DATE) AS ds, {money('order_value')} AS y FROM silver_orders GROUP BY 1"""


@query("daily_demand", "E20", "SELECT strftime(ds, '%Y-%m-%d') AS ds, y FROM daily_value")
def daily_demand(t):
    return ops.daily_demand(t.silver_orders()).withColumn("ds", F.date_format("ds", "yyyy-MM-dd"))


@query("demand_linear", "K12", f"""
SELECT strftime(CAST(now AS DATE) + CAST(i AS INTEGER), '%Y-%m-%d') AS ds,
       {rnd('base + base * 0.001::DOUBLE * i', 2)} AS yhat, {rnd('(base + base * 0.001::DOUBLE * i) * 0.85::DOUBLE', 2)} AS yhat_lower,
       {rnd('(base + base * 0.001::DOUBLE * i) * 1.15::DOUBLE', 2)} AS yhat_upper, {rnd('base * 0.001::DOUBLE * i', 2)} AS trend
FROM (SELECT {money('order_value')} / count(*) AS base FROM silver_orders), range(1, 31) r(i), anchor""")
def demand_linear(t):
    return ops.linear_rule(t.silver_orders(), t.order_anchor())


def trend_sql(source, key=""):
    lead = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""
SELECT {lead}strftime(last + CAST(i AS INTEGER), '%Y-%m-%d') AS ds,
       {rnd('(level + slope * (date_diff(\'day\', DATE \'1995-01-01\', last) + i)) / 100', 2)} AS yhat,
       {rnd('(level + slope * (date_diff(\'day\', DATE \'1995-01-01\', last) + i)) / 100 - spread * 1.2815515655446004::DOUBLE / 100', 2)} AS yhat_lower,
       {rnd('(level + slope * (date_diff(\'day\', DATE \'1995-01-01\', last) + i)) / 100 + spread * 1.2815515655446004::DOUBLE / 100', 2)} AS yhat_upper,
       {rnd('(level + slope * (date_diff(\'day\', DATE \'1995-01-01\', last) + i)) / 100', 2)} AS trend
FROM (SELECT *, (sy - slope * sx) / n AS level, sqrt(greatest(syy - sy * sy / n - slope * cxy, 0.0::DOUBLE) / (n - 2)) AS spread
  FROM (SELECT *, cxy / (sxx - sx * sx / n) AS slope FROM (SELECT *, sxy - sx * sy / n AS cxy
    FROM (SELECT {lead}count(*)::DOUBLE AS n, max(ds) AS last, sum(x)::DOUBLE AS sx, sum(v)::DOUBLE AS sy, sum(x * x)::DOUBLE AS sxx,
                 sum(x * v)::DOUBLE AS sxy, sum(v * v)::DOUBLE AS syy
          FROM (SELECT *, CAST(date_diff('day', DATE '1995-01-01', ds) AS HUGEINT) AS x,
                       CAST(CAST(y AS DECIMAL(18,2)) * 100 AS HUGEINT) AS v FROM {source}) {group})
    WHERE n >= 10))), range(1, 31) r(i)"""


@query("demand_trend", "K13", trend_sql("daily_value"))
def demand_trend(t):
    return ops.trend_forecast(ops.daily_demand(t.silver_orders()))


TABLES["daily_product_value"] = f"""
SELECT product, CAST(expected_delivery AS DATE) AS ds, {money('order_value')} AS y FROM silver_orders GROUP BY 1, 2"""


@query("demand_trend_product", "K13", trend_sql("daily_product_value", "product"))
def demand_trend_product(t):
    return ops.trend_forecast(ops.daily_demand(t.silver_orders(), "product"), "product")


def bent_sql(source, key=""):
    """Normal equations of level, slope and eight hinges for each key, and the same elimination row by row."""
    lead, size = (f"{key}, " if key else ""), ops.BENDS + 2
    group = f"GROUP BY {key}" if key else ""
    same = f"b.{key} IS NOT DISTINCT FROM s.{key}" if key else "true"
    pairs = [(i, j) for i in range(1, size + 1) for j in range(i, size + 1)]
    sums = ", ".join([f"sum(t[{i}] * t[{j}])::DOUBLE AS s{i}_{j}" for i, j in pairs] + [
        f"sum(t[{i}] * v)::DOUBLE AS r{i}" for i in range(1, size + 1)])

    def cell(i, j):
        s = f"s{min(i, j)}_{max(i, j)}"
        return f"CASE WHEN {s} = 0 THEN 1.0::DOUBLE ELSE {s} + {s} * {ops.RIDGE}::DOUBLE END" if i == j and i > 2 else s

    matrix = ", ".join("[" + ", ".join([cell(i, j) for j in range(1, size + 1)] + [f"r{i}"]) + "]" for i in range(1, size + 1))
    explained = "0.0::DOUBLE + " + " + ".join(f"m[{i}][{size + 1}] * r{i}" for i in range(1, size + 1))
    yhat = f"m[1][{size + 1}] + m[2][{size + 1}] * d" + "".join(
        f" + m[{j + 2}][{size + 1}] * greatest(d - s[{j}], 0)" for j in range(1, ops.BENDS + 1))
    band = f"sqrt(greatest(vv - explained, 0.0::DOUBLE) / (n - 2)) * {ops.BAND}::DOUBLE"
    figures = {"yhat": "yhat", "yhat_lower": "yhat - band", "yhat_upper": "yhat + band", "trend": "yhat"}
    return f"""
SELECT {lead}ds, {", ".join(f"{rnd(f'({e}) / 100', 2)} AS {c}" for c, e in figures.items())} FROM (
WITH RECURSIVE b AS (SELECT *, list_transform(range(1, {ops.BENDS + 1}), lambda j:
    floor(date_diff('day', f, l) * {ops.BENT_SHARE}::DOUBLE * j / {float(ops.BENDS)}::DOUBLE)::BIGINT) AS s
  FROM (SELECT {lead}min(ds) AS f, max(ds) AS l, count(*) AS n FROM {source} {group}) WHERE n >= 10),
r AS (SELECT b.*, list_concat([1, x], list_transform(b.s, lambda p: greatest(x - p, 0))) AS t, v FROM (
    SELECT s.*, CAST(CAST(y AS DECIMAL(18,2)) * 100 AS HUGEINT) AS v FROM {source} s) s JOIN b ON {same},
    LATERAL (SELECT date_diff('day', b.f, s.ds) AS x)),
q AS (SELECT {lead}f, l, n, s, {sums}, sum(v * v)::DOUBLE AS vv FROM (
    SELECT * REPLACE (list_transform(t, lambda a: a::HUGEINT) AS t) FROM r) GROUP BY ALL),
e(k, m, {lead}f, l, n, s, vv{"".join(f", r{i}" for i in range(1, size + 1))}) AS (
  SELECT 1, [{matrix}], {lead}f, l, n, s, vv{"".join(f", r{i}" for i in range(1, size + 1))} FROM q
  UNION ALL
  SELECT k + 1, list_transform(m, lambda row, i: CASE WHEN i = k THEN list_transform(m[k], lambda v: v / m[k][k])
    ELSE list_transform(row, lambda v, c: v - row[k] * (m[k][c] / m[k][k])) END), {lead}f, l, n, s, vv{"".join(f", r{i}" for i in range(1, size + 1))}
  FROM e WHERE k <= {size})
SELECT {lead}strftime(l + CAST(i AS INTEGER), '%Y-%m-%d') AS ds, {yhat} AS yhat, {band} AS band
FROM (SELECT *, {explained} AS explained FROM e WHERE k = {size + 1}), range(1, 31) g(i),
  LATERAL (SELECT date_diff('day', f, l) + i AS d))"""


TABLES["bent_daily_value"] = """
SELECT ds, y + CASE WHEN ds > DATE '1998-01-01' THEN date_diff('day', DATE '1998-01-01', ds) * 100 ELSE 0 END AS y FROM daily_value"""


@query("demand_changepoints", "K13", f"""
SELECT 'as it is' AS series, * FROM ({bent_sql("daily_value")})
UNION ALL SELECT 'bent', * FROM ({bent_sql("bent_daily_value")})""")
def demand_changepoints(t):
    """Daily value with a trend that may bend; once as it is, once with a slope of a hundred a day added from 1998 on."""
    daily = ops.daily_demand(t.silver_orders())
    days = F.greatest(F.datediff("ds", F.lit("1998-01-01").cast("date")), F.lit(0))
    bent = daily.withColumn("y", F.col("y") + days * 100)
    both = daily.withColumn("series", F.lit("as it is")).unionByName(bent.withColumn("series", F.lit("bent")))
    return ops.bent_forecast(both, "series")


@query("demand_changepoints_product", "K13", bent_sql("daily_product_value", "product"))
def demand_changepoints_product(t):
    return ops.bent_forecast(ops.daily_demand(t.silver_orders(), "product"), "product")


TABLES["launch_orders"] = """
SELECT product, order_value, expected_delivery FROM silver_orders UNION ALL
SELECT 'NEW-' || product || '-' || quantity, order_value, expected_delivery FROM silver_orders WHERE inventory_level < 2"""
TABLES["launch_daily"] = f"""
SELECT product, CAST(expected_delivery AS DATE) AS ds, {money('order_value')} AS y FROM launch_orders GROUP BY 1, 2"""


@query("demand_forecast_all", "K13 K12", f"""
SELECT *, 'fitted' AS method FROM ({trend_sql("launch_daily", "product")})
UNION ALL
SELECT product, strftime(CAST(now AS DATE) + CAST(i AS INTEGER), '%Y-%m-%d') AS ds,
       {rnd('base + base * 0.001::DOUBLE * i', 2)} AS yhat, {rnd('(base + base * 0.001::DOUBLE * i) * 0.85::DOUBLE', 2)} AS yhat_lower,
       {rnd('(base + base * 0.001::DOUBLE * i) * 1.15::DOUBLE', 2)} AS yhat_upper, {rnd('base * 0.001::DOUBLE * i', 2)} AS trend,
       'linear' AS method
FROM (SELECT product, {money('order_value')} / count(*) AS base FROM launch_orders WHERE product IN
        (SELECT product FROM launch_daily GROUP BY 1 HAVING count(*) < 10) GROUP BY 1), range(1, 31) r(i), anchor""")
def demand_forecast_all(t):
    """Every product has thirty days, also those with few dates, such as added products just launched."""
    orders = t.silver_orders().select("product", "order_value", "expected_delivery", "inventory_level", "quantity")
    new = orders.filter("inventory_level < 2").withColumn(
        "product", F.concat_ws("-", F.lit("NEW"), "product", F.col("quantity").cast("string")))
    return ops.demand_forecast(orders.unionByName(new), t.order_anchor(), "product")
