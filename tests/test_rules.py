import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborlight.functions import numeric, rules
from harborlight.operators import actions, alerts, deviations, suppliers

ORDER = {"order_id": "O1", "supplier_id": "S1", "product": "P", "region": "EU", "quantity": 100,
         "unit_price": 50.0, "order_value": 5000.0, "delay_days": 0, "status": "IN_TRANSIT",
         "inventory_level": 50.0}
SCHEMA = ("order_id string, supplier_id string, product string, region string, quantity int, "
          "unit_price double, order_value double, delay_days int, status string, inventory_level double")


def order(spark, *changes):
    return spark.createDataFrame([tuple({**ORDER, **c}.values()) for c in changes], SCHEMA)


@pytest.mark.parametrize("delay,severity", [
    (0, None), (3, "MEDIUM"), (8, "HIGH"), (10, "HIGH"), (14, "HIGH"), (15, "CRITICAL")])
def test_delay_severity(spark, delay, severity):
    found = deviations.all_matches(order(spark, {"delay_days": delay})).collect()
    assert [r.severity for r in found] == ([severity] if severity else [])


@pytest.mark.parametrize("level,severity", [(4.0, "HIGH"), (9.0, "MEDIUM"), (10.0, None)])
def test_stockout(spark, level, severity):
    found = deviations.all_matches(order(spark, {"inventory_level": level})).collect()
    assert [(r.type, r.severity) for r in found] == ([("STOCKOUT", severity)] if severity else [])


@pytest.mark.parametrize("value,hit", [(100000.0, False), (100001.0, True)])
def test_value_anomaly(spark, value, hit):
    found = deviations.all_matches(order(spark, {"order_value": value})).collect()
    assert [r.type for r in found] == (["ANOMALY"] if hit else [])


def test_one_order_can_give_three_findings(spark):
    found = deviations.all_matches(
        order(spark, {"delay_days": 15, "inventory_level": 3.0, "order_value": 200000.0})).collect()
    assert {r.type for r in found} == {"DELAY", "STOCKOUT", "ANOMALY"}
    assert len({r.deviation_id for r in found}) == 3
    text = {r.type: r.recommended_action for r in found}
    assert text["DELAY"] == "Escalate to supplier S1: order delayed 15 days"
    assert text["STOCKOUT"] == "Emergency restock for P — inventory at 3.0%"
    assert text["ANOMALY"] == "Review unusually high order value $200,000.00 from S1"


def test_first_match_rules(spark):
    found = deviations.first_match(order(
        spark, {"order_id": "a", "delay_days": 8, "inventory_level": 1.0}, {"order_id": "b", "inventory_level": 4.0},
        {"order_id": "c", "inventory_level": 9.0}, {"order_id": "d", "order_value": 100001.0}, {"order_id": "e"}))
    got = {r.order_id: (r.deviation_type, r.severity) for r in found.collect()}
    assert got == {"a": ("DELAY", "HIGH"), "b": ("STOCKOUT", "HIGH"), "c": ("STOCKOUT", "MEDIUM"), "d": ("ANOMALY", "MEDIUM")}


@pytest.mark.parametrize("state,delay,want", [
    ("PLACED", 0, "PENDING"), ("SHIPPED", 0, "IN_TRANSIT"), ("RECEIVED", 2, "DELAYED"),
    ("REJECTED", 2, "CANCELLED"), ("SOMETHING", 0, "PENDING"), ("ROLLBACK", 0, "CANCELLED")])
def test_external_status(spark, state, delay, want):
    df = spark.createDataFrame([(state, delay)], "s string, d int")
    assert df.select(rules.canonical_status(F.col("s"), F.col("d"))).first()[0] == want


@pytest.mark.parametrize("value,digits,want", [
    (2.345, 1, 2.3), (0.5, 0, 1.0), (-1.25, 1, -1.2), (1e17, 2, 1e17), (None, 2, None)])
def test_round_half_up(spark, value, digits, want):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(numeric.round_to("x", digits)).first()[0] == want


@pytest.mark.parametrize("text,as_double,as_int", [
    ("3.9", 3.9, 3), ("-3.9", -3.9, -3), ("", 7.0, 7), (None, 7.0, 7), ("abc", 7.0, 7), (" 4 ", 4.0, 4), ("1e12", 1e12, 7)])
def test_lenient_numbers(spark, text, as_double, as_int):
    df = spark.createDataFrame([(text,)], "x string")
    row = df.select(numeric.to_double(F.col("x"), 7.0).alias("d"), numeric.to_int(F.col("x"), 7).alias("i")).first()
    assert (row.d, row.i) == (as_double, as_int)


@pytest.mark.parametrize("value,delay,cost,tier", [
    (5000.0, 0, 0.0, "MODERATE"), (100010.0, 5, 10001.0, "CRITICAL_COST"),
    (100000.0, 5, 10000.0, "CRITICAL_COST"), (20000.0, 5, 2000.0, "HIGH_COST")])
def test_alert_cost(spark, value, delay, cost, tier):
    o = order(spark, {"order_value": value, "delay_days": delay})
    d = spark.createDataFrame([("D1", "O1")], "deviation_id string, order_id string")
    row = alerts.enriched(d, o).first()
    assert (row.cost_impact_usd, row.risk_tier) == (cost, tier)


def test_alert_without_order_costs_nothing(spark):
    d = spark.createDataFrame([("D1", "none")], "deviation_id string, order_id string")
    row = alerts.enriched(d, order(spark, {})).first()
    assert (row.cost_impact_usd, row.risk_tier, row.supplier_id) == (0.0, "MODERATE", None)


def test_trend_counts_other_severities_as_medium_and_fills_days(spark, rows):
    d = spark.createDataFrame(
        [(dt.datetime(2024, 1, 3), "LOW"), (dt.datetime(2024, 1, 3), "CRITICAL"), (dt.datetime(2023, 12, 1), "HIGH")],
        "detected_at timestamp_ntz, severity string")
    got = rows(alerts.trend(d, F.lit("2024-01-03").cast("timestamp_ntz"), 3), "date")
    assert [(r["date"], r["CRITICAL"], r["MEDIUM"], r["total"]) for r in got] == [
        ("2024-01-01", 0, 0, 0), ("2024-01-02", 0, 0, 0), ("2024-01-03", 1, 1, 2)]


def test_cost_analytics_zero_spend(spark):
    o = order(spark, {"order_value": 0.0})
    s = spark.createDataFrame([("S1", "Name", "EU", 0.9)], "supplier_id string, name string, region string, trust_score double")
    row = suppliers.cost_analytics(o, s).first()
    assert row.cost_efficiency_score == 100.0 and row.delay_rate_pct == 0.0 and row.avg_delay_days_when_delayed is None


def test_success_rate_is_null_without_resolved(spark):
    a = spark.createDataFrame([("NOTIFY", False, "PENDING", 0.5)],
                              "action_type string, resolved boolean, status string, confidence double")
    row = actions.success_rates(a).first()
    assert row.success_rate_pct is None and row.total == 1


def test_rolling_count_spans_slice_borders(spark, rows):
    at = dt.datetime(2024, 1, 1, 23, 0)
    times = [at, at + dt.timedelta(hours=2), at + dt.timedelta(hours=24), at + dt.timedelta(hours=26, seconds=1)]
    d = spark.createDataFrame([("S", t, "CRITICAL") for t in times] + [("S", at, "HIGH")],
                              "supplier_id string, detected_at timestamp_ntz, severity string")
    got = rows(alerts.rolling_critical(d), "detected_at")
    assert [r["critical_24h"] for r in got] == [1, 2, 3, 2]


def gate_input(spark, confidence, severity, value, level="CRITICAL", cap=50000.0, kind="EXPEDITE"):
    import json

    payload = json.dumps({k: v for k, v in {
        "execution_confidence": confidence, "severity": severity, "order_value": value}.items() if v is not None})
    a = spark.createDataFrame([("A", "D", kind, payload)], "action_id string, deviation_id string, action_type string, payload string")
    d = spark.createDataFrame([("D", "O1")], "deviation_id string, order_id string")
    p = spark.createDataFrame([("S1", level, cap)],
                              "supplier_id string, require_approval_at_severity string, require_approval_above_value double")
    return actions.gate(a, d, order(spark, {"order_value": 60000.0}), p).first()


@pytest.mark.parametrize("confidence,severity,value,level,cap,reason", [
    (0.69, "LOW", 10.0, "CRITICAL", 50000.0, "CONFIDENCE"),
    (0.70, "LOW", 10.0, "CRITICAL", 50000.0, None),
    (None, "HIGH", 10.0, "HIGH", 50000.0, "SEVERITY"),
    (0.9, "MEDIUM", 50000.0, "CRITICAL", 50000.0, None),
    (0.9, "MEDIUM", 50001.0, "CRITICAL", 50000.0, "VALUE"),
    (0.9, "MEDIUM", None, "CRITICAL", 50000.0, "VALUE"),  # value taken from the order
])
def test_gate(spark, confidence, severity, value, level, cap, reason):
    row = gate_input(spark, confidence, severity, value, level, cap)
    assert row.block_reason == reason
    assert row.final_action == ("ESCALATE" if reason else "EXPEDITE")


def test_gate_leaves_escalations_alone(spark):
    assert gate_input(spark, 0.1, "CRITICAL", 1e9, kind="ESCALATE").block_reason is None


def test_alternates_leave_out_the_own_supplier(spark, rows):
    s = spark.createDataFrame([("S1", "EU", 0.99), ("S2", "EU", 0.9), ("S3", "EU", 0.8), ("S4", "EU", 0.7), ("S5", "US", 1.0)],
                              "supplier_id string, region string, trust_score double")
    o = order(spark, {"order_id": "a", "supplier_id": "S1"}, {"order_id": "b", "supplier_id": "S9"}).select(
        "order_id", "supplier_id", "region")
    got = rows(suppliers.alternates_for(o, s, 0.75, 2), "order_id", "alt_rank")
    assert [(r["order_id"], r["alt_supplier_id"]) for r in got] == [("a", "S2"), ("a", "S3"), ("b", "S1"), ("b", "S2")]


def test_concentration_buckets(spark):
    df = spark.createDataFrame([(70.0,), (69.9,), (40.0,), (39.9,)], "x double")
    assert [r[0] for r in df.select(rules.concentration_bucket(F.col("x"))).collect()] == ["HIGH", "MEDIUM", "MEDIUM", "LOW"]
