"""Data-quality queries."""

from pyspark.sql import functions as F

from harborlight.operators import forecast, quality as ops
from harborlight.operators import orders as ord_ops
from harborlight.oracle import ORDER_STATUS, rnd
from harborlight.plans.forecast import trend_sql
from harborlight.plans.suppliers import DIM_SQL, supplier_dimension
from harborlight.operators import alerts
from harborlight.registry import query
from harborlight.session import run_dir
from harborlight.sources import sinks

BASIC = ("order_id", "supplier_id", "status", "delay_days", "inventory_level")


def rule_sql(name, failed, source):
    return (f"SELECT '{name}' AS rule, ({failed}) = 0 AS passed, ({failed}) AS failed_count, "
            f"count(*) AS total_count FROM {source}")


def failing(condition):
    return f"count(*) FILTER (WHERE {condition})"


@query("dq_suite", "J01 J02 J03 J04", " UNION ALL ".join([
    rule_sql("expect_order_id_not_null", failing("order_id IS NULL"), "raw_orders"),
    rule_sql("expect_delay_days_between", failing("delay_days < 0 OR delay_days > 365"), "raw_orders"),
    rule_sql("expect_status_in_set", failing(
        f"status IS NULL OR (status NOT IN {ORDER_STATUS} AND status NOT IN ('CRF', 'DTD'))"), "raw_orders")]))
def dq_suite(t):
    return ops.run_suite(t.bronze_orders(*BASIC))


@query("dq_invalid_sample", "J02", f"""
SELECT DISTINCT status FROM raw_orders WHERE status NOT IN {ORDER_STATUS} ORDER BY 1 LIMIT 5""")
def dq_invalid_sample(t):
    return ops.invalid_sample(t.bronze_orders("status"), "status", ops.business.ORDER_STATUSES)


@query("dq_expectations", "J05", "SELECT 'orders' AS suite, * FROM (" + " UNION ALL ".join([
    rule_sql("expect_order_id_not_null", failing("order_id IS NULL"), "raw_orders"),
    rule_sql("expect_status_in_set", failing(f"status IS NULL OR status NOT IN {ORDER_STATUS}"), "raw_orders"),
    rule_sql("expect_delay_days_between", failing("delay_days < 0 OR delay_days > 365"), "raw_orders"),
    rule_sql("expect_inventory_level_between", failing("inventory_level < 0 OR inventory_level > 100"), "raw_orders"),
]) + ") UNION ALL SELECT 'suppliers', * FROM (" + " UNION ALL ".join([
    rule_sql("expect_supplier_id_not_null", failing("supplier_id IS NULL"), "suppliers"),
    rule_sql("expect_trust_score_between", failing("trust_score < 0 OR trust_score > 1"), "suppliers"),
]) + ")")
def dq_expectations(t):
    """Suites declared as data, the way a JSON file states them."""
    def expect(kind, **kwargs):
        return {"expectation_type": f"expect_column_values_to_{kind}", "kwargs": kwargs}

    orders = {"expectations": [
        expect("not_be_null", column="order_id"),
        expect("be_in_set", column="status", value_set=ops.business.ORDER_STATUSES),
        expect("be_between", column="delay_days", min_value=0, max_value=365),
        expect("be_between", column="inventory_level", min_value=0, max_value=100),
    ]}
    suppliers = {"expectations": [
        expect("not_be_null", column="supplier_id"),
        expect("be_between", column="trust_score", min_value=0, max_value=1),
    ]}
    first = ops.evaluate(t.bronze_orders(*BASIC), ops.from_expectations(orders))
    second = ops.evaluate(t.suppliers(), ops.from_expectations(suppliers))
    return first.select(F.lit("orders").alias("suite"), "*").unionByName(
        second.select(F.lit("suppliers").alias("suite"), "*"))


def contract_sql(source, checks, anchor=""):
    parts = [
        f"SELECT '{name}' AS \"check\", ({measure})::DOUBLE AS observed, ({measure})::DOUBLE {cond} AS passed FROM {source}"
        for name, measure, cond in checks]
    return " UNION ALL ".join(parts)


@query("dq_contract_orders", "J06", contract_sql("raw_orders", [
    ("row_count > 0", "count(*)", "> 0"),
    ("missing_count(order_id) = 0", failing("order_id IS NULL"), "= 0"),
    ("duplicate_count(order_id) = 0", "count(order_id) - count(DISTINCT order_id)", "= 0"),
    ("missing_count(supplier_id) = 0", failing("supplier_id IS NULL"), "= 0"),
    ("missing_count(status) = 0", failing("status IS NULL"), "= 0"),
    ("invalid_count(status) = 0", failing(f"status NOT IN {ORDER_STATUS}"), "= 0"),
    ("avg(delay_days) < 30", "sum(delay_days)::DOUBLE / count(delay_days)", "< 30"),
    ("max(delay_days) < 365", "max(delay_days)", "< 365"),
    ("min(unit_price) >= 0", "min(unit_price)", ">= 0"),
    ("min(quantity) >= 1", "min(quantity)", ">= 1"),
    ("freshness(created_at) < 25h",
     "date_diff('second', max(created_at), (SELECT now FROM anchor)) / 3600.0::DOUBLE", "< 25"),
]))
def dq_contract_orders(t):
    raw = t.bronze_orders("order_id", "supplier_id", "status", "delay_days", "unit_price", "quantity", "created_at")
    return ops.contract(raw, ops.order_contract(t.order_anchor()))


@query("dq_contract_silver", "J06", contract_sql("silver_orders", [
    ("row_count > 0", "count(*)", "> 0"),
    ("missing_count(order_id) = 0", failing("order_id IS NULL"), "= 0"),
    ("duplicate_count(order_id) = 0", "count(order_id) - count(DISTINCT order_id)", "= 0"),
    ("missing_count(status) = 0", failing("status IS NULL"), "= 0"),
    ("missing_count(supplier_id) = 0", failing("supplier_id IS NULL"), "= 0"),
    ("avg(delay_days) between -1 and 90", "sum(delay_days)::DOUBLE / count(delay_days)", "BETWEEN -1 AND 90"),
    ("min(order_value) >= 0", "min(order_value)", ">= 0"),
]))
def dq_contract_silver(t):
    return ops.contract(t.silver_orders(), ops.silver_contract())


_MODEL_SOURCES = {"fct_shipments": "fct_shipments", "dim_suppliers": f"({DIM_SQL})", "stg_orders": "stg_orders",
                  "stg_suppliers": "stg_suppliers",
                  "agg_control_tower": "(SELECT count(*) AS total_shipments, sum(order_value) AS pipeline_value FROM fct_shipments)"}


def _model_sql():
    parts = []
    for model, rules in ops.MODEL_TESTS.items():
        for r in rules:
            c = r.column
            failed = {
                "not_null": failing(f"{c} IS NULL"),
                "unique": f"count({c}) - count(DISTINCT {c})",
                "accepted": failing(f"{c} NOT IN {ORDER_STATUS}"),
                "between": failing(" OR ".join(
                    ([f"{c} < {r.low}"] if r.low is not None else []) + ([f"{c} > {r.high}"] if r.high is not None else []))
                    if r.kind == "between" else "false"),
            }[r.kind]
            parts.append(f"SELECT '{model}' AS model, * FROM ({rule_sql(r.name, failed, _MODEL_SOURCES[model])})")
    return " UNION ALL ".join(parts)


@query("dq_dbt", "J07", _model_sql())
def dq_dbt(t):
    staged, staged_sup = t.staged_orders(), t.suppliers()
    facts = ord_ops.shipments(staged)
    models = {
        "fct_shipments": facts,
        "dim_suppliers": supplier_dimension(t),
        "stg_orders": staged,
        "stg_suppliers": ops_staged(staged_sup),
        "agg_control_tower": alerts.control_tower(facts),
    }
    out = None
    for model, rules in ops.MODEL_TESTS.items():
        rows = ops.evaluate(models[model], rules).select(F.lit(model).alias("model"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


def ops_staged(suppliers):
    from harborlight.operators.suppliers import staged_suppliers

    return staged_suppliers(suppliers)


@query("dq_singular", "J08", """
SELECT 'delay_days_non_negative' AS rule, order_id AS key, delay_days::DOUBLE AS value FROM fct_shipments WHERE delay_days < 0
UNION ALL SELECT 'no_negative_order_values', order_id, order_value FROM fct_shipments WHERE order_value < 0
UNION ALL SELECT 'trust_score_range', supplier_id, trust_score FROM stg_suppliers WHERE trust_score < 0 OR trust_score > 1""")
def dq_singular(t):
    """Offending rows of three singular rules; the two on facts share a scan."""
    delay, value = F.col("delay_days"), F.col("order_value")

    def broken(name, condition, seen):
        return F.when(condition, F.struct(F.lit(name).alias("rule"), seen.cast("double").alias("value")))

    facts = ord_ops.shipments(t.staged_orders())
    found = F.filter(F.array(
        broken("delay_days_non_negative", delay < 0, delay),
        broken("no_negative_order_values", value < 0, value)), lambda r: r.isNotNull())
    bad = facts.select(F.col("order_id").alias("key"), F.inline(found))
    trust = ops_staged(t.suppliers()).filter(~F.col("trust_score").between(0, 1)).select(
        F.col("supplier_id").alias("key"), F.lit("trust_score_range").alias("rule"),
        F.col("trust_score").alias("value"))
    return bad.unionByName(trust)


@query("dq_silver_audit", "J09", f"""
SELECT 'null_order_id' AS metric, {failing('order_id IS NULL')} AS value FROM raw_orders
UNION ALL SELECT 'null_supplier_id', {failing('supplier_id IS NULL')} FROM raw_orders
UNION ALL SELECT 'null_status', {failing('status IS NULL')} FROM raw_orders
UNION ALL SELECT 'invalid_status_count', {failing(f'status IS NULL OR status NOT IN {ORDER_STATUS}')} FROM raw_orders
UNION ALL SELECT 'delay_days_out_of_range', {failing('delay_days < -1 OR delay_days > 365')} FROM raw_orders
UNION ALL SELECT 'duplicate_order_ids', count(*) - (SELECT count(*) FROM (SELECT DISTINCT order_id FROM raw_orders)) FROM raw_orders
UNION ALL SELECT 'bad_trust_score_count', {failing('trust_score < 0 OR trust_score > 1')} FROM suppliers""")
def dq_silver_audit(t):
    return ops.silver_audit(t.bronze_orders(*BASIC)).unionByName(ops.trust_audit(t.suppliers()))


@query("dq_formulas", "J10", f"""
SELECT order_id, field, {rnd('want', 2)} AS expected, {rnd('got', 2)} AS actual, {rnd('err * 100', 1)} AS error_pct
FROM (SELECT *, abs(got - want) / greatest(want, 1.0::DOUBLE) AS err FROM (
  SELECT order_id, 'carrying_cost' AS field, order_value * (delay_days::DOUBLE / 30.0::DOUBLE) * 0.02::DOUBLE AS want,
         order_value * (delay_days::DOUBLE / 30.0::DOUBLE) * 0.02::DOUBLE * (1.0::DOUBLE + (_k1 % 8)::DOUBLE / 160.0::DOUBLE) AS got
  FROM silver_orders WHERE delay_days > 0 AND order_value > 0
  UNION ALL
  SELECT order_id, 'delay_cost', delay_days * 500.0::DOUBLE,
         CASE WHEN _k1 % 9 = 0 THEN delay_days * 520.0::DOUBLE ELSE delay_days * 500.0::DOUBLE END
  FROM silver_orders WHERE delay_days > 0 AND order_value > 0)) WHERE err > 0.02""")
def dq_formulas(t):
    """Gold rows with stored costs, some of them wrong by a few percent."""
    d = F.col("delay_days").cast("double")
    k = F.col("_k1")
    carry = F.col("order_value") * (d / F.lit(30.0)) * F.lit(0.02) * (
        F.lit(1.0) + (k % 8).cast("double") / F.lit(160.0))
    gold = t.silver_orders().select(
        "order_id", "order_value", "delay_days", carry.alias("carrying_cost"),
        F.when(k % 9 == 0, d * F.lit(520.0)).otherwise(d * F.lit(500.0)).alias("delay_cost"))
    return ops.formula_mismatches(gold)


@query("dq_bounds", "J11", f"""
SELECT 'bad_delay_probability' AS metric, {failing('delay_probability < 0 OR delay_probability > 1')} AS value FROM decay_risk
UNION ALL SELECT 'bad_confidence', {failing('confidence < 0 OR confidence > 1')} FROM decay_risk
UNION ALL SELECT 'forecast_bound_violations', {failing('yhat < yhat_lower')} + {failing('yhat > yhat_upper')} FROM ({trend_sql('daily_product_value', 'product')})
UNION ALL SELECT 'negative_forecasts', {failing('yhat < 0')} FROM ({trend_sql('daily_product_value', 'product')})
UNION ALL SELECT 'negative_lower_bounds', {failing('yhat_lower < 0')} FROM ({trend_sql('daily_product_value', 'product')})""")
def dq_bounds(t):
    silver = t.silver_orders()
    risk = ops.bounds_audit(forecast.decay_risk(silver, t.order_anchor()))
    demand = forecast.trend_forecast(forecast.daily_demand(silver, "product"), "product")
    return risk.unionByName(ops.forecast_audit(demand))


@query("schema_drift", "H04", """
SELECT unnest(['unit_price', 'delay_days']) AS missing_column, count(*) AS rows FROM raw_orders""")
def schema_drift(t):
    """An order file that came without two of the required columns."""
    came = [c for c in ord_ops.REQUIRED_ORDER_COLUMNS if c not in ("unit_price", "delay_days")]
    return ops.missing_columns(t.bronze_orders(*came), ord_ops.REQUIRED_ORDER_COLUMNS)


BACKFILL_SINCE = "1999-01-01"


@query("backfill_incremental", "J13 A12 A14", """
SELECT order_id, status, delay_days, created_at,
       CASE WHEN created_at >= TIMESTAMP '1999-01-01' THEN 'backfill' ELSE 'target' END AS loaded_by
FROM silver_orders""")
def backfill_incremental(t):
    """A table with the older rows, then the newer ones merged in by date."""
    silver = t.silver_orders().select("order_id", "status", "delay_days", "created_at")
    since = F.lit(BACKFILL_SINCE).cast("timestamp_ntz")
    path = run_dir(t.spark, "backfill")
    old = silver.filter(F.col("created_at") < since).withColumn("loaded_by", F.lit("target"))
    sinks.backfill(old, path, "full", ["created_at"])
    sinks.backfill(silver.withColumn("loaded_by", F.lit("backfill")), path, "incremental", ["created_at"], since)
    return t.spark.read.parquet(path)
