import datetime as dt

import pytest
from pyspark.sql import functions as F

from harborlight.operators import forecast, merge, orders
from harborlight.operators.latest import keep_last, top_per_key
from harborlight.operators.ranking import global_rank


def raw(spark, *rows):
    return spark.createDataFrame(
        list(rows), "order_id string, delay_days int, status string, at int, n int")


def test_three_filters_differ_on_unknown_delay(spark):
    df = raw(spark, ("a", None, "DELAYED", 1, 0), ("b", 400, "DELAYED", 1, 0), ("c", -1, "DELAYED", 1, 0),
             ("  ", 1, "DELAYED", 1, 0), ("", 1, "DELAYED", 1, 0), (None, 1, "DELAYED", 1, 0), ("d", 0, "CRF", 1, 0),
             ("e", 365, "DELAYED", 1, 0))
    ids = lambda x: sorted(r.order_id for r in x.select("order_id").collect())
    assert ids(orders.silver_orders(df, ["at"])) == ["a", "d", "e"]
    assert ids(orders.cleaned_orders(df)) == ["  ", "e"]
    assert ids(orders.staged_orders(df)) == ["  ", "a", "b", "c", "e"]


def test_keep_last_with_one_key_holding_most_rows(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    out = keep_last(df, ["k"], ["id"])
    assert out.count() == 10001
    assert out.filter("k = 'hot'").first().id == 29999
    plan = out._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_global_rank_with_ties_and_a_hot_value(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("v"), "id")
    got = {r.id: r["rank"] for r in global_rank(df, [F.col("v").desc(), F.col("id").asc()], "rank").collect()}
    want = sorted(((-(7 if i % 3 == 0 else i % 50), i) for i in range(5000)))
    assert got == {i: n + 1 for n, (_, i) in enumerate(want)}


def test_top_per_key(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "k string, v int")
    got = {(r.k, r.v) for r in top_per_key(df, ["k"], [F.col("v").desc()], 2).collect()}
    assert got == {("a", 3), ("a", 2), ("b", 1)}


def test_coerce_needs_its_columns_and_fixes_cells(spark):
    cols = "order_id string, supplier_id string, product string, quantity string, unit_price string, order_value string, status string, delay_days string"
    df = spark.createDataFrame([
        (" X1 ", " ", "p", "-3", "2.345", "", "shipped", "2"),
        ("X2", "s", None, "4", "2.5", "0", None, "3"),
        ("X3", "s", "p", "bad", "-1", "12.5", "delivered", "-4"),
        ("", "s", "p", "1", "1", "1", "DELIVERED", "0"),
    ], cols)
    got = {r.order_id: r for r in orders.coerce_orders(df, F.lit("2024-01-01")).collect()}
    assert set(got) == {"X1", "X2", "X3"}
    x1, x2, x3 = got["X1"], got["X2"], got["X3"]
    assert (x1.supplier_id, x1.quantity, x1.unit_price, x1.order_value, x1.status) == ("UNKNOWN", 1, 2.35, 2.35, "PENDING")
    assert (x2.product, x2.order_value, x2.status, x2.region, x2.inventory_level) == ("UNKNOWN", 10.0, "DELAYED", "UNKNOWN", 80.0)
    assert (x3.quantity, x3.unit_price, x3.delay_days, x3.status, x3.order_value) == (1, 0.0, 0, "DELIVERED", 12.5)
    assert x1.expected_delivery == "2024-01-01" and x1.actual_delivery is None
    with pytest.raises(ValueError, match="status"):
        orders.coerce_orders(df.drop("status"), F.lit("x"))
    lost = orders.rejected_table(df.drop("status", "quantity")).collect()
    assert [(r.missing, r.rows) for r in lost] == [("quantity,status", df.count())]
    assert orders.rejected_table(df).count() == 0


def test_dates_in_mixed_formats(spark):
    texts = ["2024-02-03", "2024-02-03T04:05:06", "2024-02-03T04:05:06+02:00", "02/03/2024", "invalid-date", "99/99/99", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
    got = [r.t for r in df.withColumn("t", orders.parse_timestamp(F.col("s")).cast("timestamp_ntz")).orderBy("i").collect()]
    day = dt.datetime(2024, 2, 3)
    assert got == [day, dt.datetime(2024, 2, 3, 4, 5, 6), dt.datetime(2024, 2, 3, 2, 5, 6), day, None, None, None, None]


def test_whole_days_cut_toward_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2, 12)), (dt.datetime(2024, 1, 2, 12), dt.datetime(2024, 1, 1))],
                               "a timestamp_ntz, b timestamp_ntz")
    assert [r[0] for r in df.select(orders.whole_days_between(F.col("a"), F.col("b"))).collect()] == [1, -1]


def test_unit_price(spark):
    df = spark.createDataFrame([(5000.0, 100), (5000.0, 0)], "v double, q int")
    assert [r[0] for r in df.select(orders.unit_price(F.col("v"), F.col("q"))).collect()] == [50.0, 5000.0]


def scoring(spark, late, on_time):
    start = dt.datetime(2016, 1, 1)
    data = [("S1", f"O{i}", start + dt.timedelta(days=i), 5 if i < late else 0) for i in range(late + on_time)]
    return spark.createDataFrame(data, "supplier_id string, order_id string, expected_delivery timestamp_ntz, delay_days int")


def test_decay_risk_extremes(spark):
    def run(late, on_time):
        df = scoring(spark, late, on_time)
        return forecast.decay_risk(df, df.agg(F.max("expected_delivery")).scalar()).first()

    assert run(0, 10).delay_probability == 0.0
    assert run(10, 0).delay_probability > 0.95
    assert run(1, 0).confidence == 0.0
    assert run(50, 50).confidence == 0.9
    # late orders lie further back than punctual ones, so they weigh less
    assert run(50, 50).delay_probability < 0.5


def test_decay_risk_unknown_dates_count_as_180_days(spark):
    df = spark.createDataFrame([("S", None, 5), ("S", dt.datetime(2020, 1, 1), 0)],
                               "supplier_id string, expected_delivery timestamp_ntz, delay_days int")
    import math

    w = math.exp(-2)
    got = forecast.decay_risk(df, F.lit("2020-01-01").cast("timestamp_ntz")).first().delay_probability
    assert abs(got - w / (1 + w)) < 1e-6


def predictions(spark, suppliers, due="2019-12-31"):
    o = spark.createDataFrame([("O", "S", 10.0, "IN_TRANSIT", dt.datetime.fromisoformat(due))],
                              "order_id string, supplier_id string, order_value double, status string, expected_delivery timestamp_ntz")
    s = spark.createDataFrame(suppliers, "supplier_id string, name string, trust_score double, avg_delay_days double")
    return forecast.delay_predictions(o, s, F.lit("2020-01-01").cast("timestamp_ntz")).first()


def test_delay_predictions(spark):
    row = predictions(spark, [("S", "n", 0.9, 0.0)])
    assert (row.delay_probability, row.is_overdue, row.risk_level) == (0.2, True, "MEDIUM")
    assert predictions(spark, []).supplier_trust == 0.7
    assert predictions(spark, [("S", "n", 0.0, 28.0)]).delay_probability == 0.99
    # half a day late is a full day below zero
    assert predictions(spark, [], "2019-12-31T12:00:00").days_remaining == -1


def test_trend_needs_ten_dates_and_follows_a_line(spark):
    daily = spark.createDataFrame(
        [("a", dt.date(2020, 1, 1) + dt.timedelta(days=i), 100.0 + 2 * i) for i in range(20)]
        + [("b", dt.date(2020, 1, 1) + dt.timedelta(days=i), 5.0) for i in range(9)], "k string, ds date, y double")
    got = forecast.trend_forecast(daily, "k", periods=3).orderBy("ds").collect()
    assert [r.k for r in got] == ["a"] * 3 and all(r.trend == r.yhat for r in got)
    orders = daily.select("k", F.col("ds").cast("timestamp").alias("expected_delivery"), F.col("y").alias("order_value"))
    every = forecast.demand_forecast(orders, F.lit("2020-02-01"), "k").collect()
    assert sorted((r.k, r.method) for r in every) == [("a", "fitted")] * 30 + [("b", "linear")] * 30
    assert {(r.yhat, r.trend) for r in every if r.k == "b" and r.ds == "2020-02-11"} == {(5.05, 0.05)}
    alone = forecast.demand_forecast(orders.filter("k = 'b'"), F.lit("2020-02-01")).collect()
    assert {r.method for r in alone} == {"linear"} and len(alone) == 30
    for i, r in enumerate(got):
        assert abs(r.yhat - (100 + 2 * (20 + i))) < 0.02 and abs(r.yhat_upper - r.yhat) < 0.02


def orders_frame(spark, *rows):
    return spark.createDataFrame(list(rows), "order_id string, status string, v int, at int")


def test_upsert_replaces_and_adds_columns(spark, rows):
    t = orders_frame(spark, ("a", "x", 1, 1), ("b", "x", 1, 1))
    b = orders_frame(spark, ("b", "y", 2, 2), ("b", "z", 3, 3), ("c", "y", 2, 2)).withColumn("extra", F.lit(9))
    got = rows(merge.upsert(t, b, ["order_id"], ["at"]), "order_id")
    assert [(r["order_id"], r["status"], r["extra"]) for r in got] == [("a", "x", None), ("b", "z", 9), ("c", "y", 9)]


def test_upsert_columns_keeps_the_rest(spark, rows):
    t = orders_frame(spark, ("a", "x", 1, 1), ("b", "x", 1, 1))
    b = orders_frame(spark, ("b", None, 2, 2), ("c", "y", 2, 2))
    got = rows(merge.upsert_columns(t, b, "order_id", ["status"], ["at"]), "order_id")
    assert [(r["order_id"], r["status"], r["v"]) for r in got] == [("a", "x", 1), ("b", None, 1), ("c", "y", 2)]


def test_insert_absent_and_semi_are_complements(spark):
    t = orders_frame(spark, ("a", "x", 1, 1))
    b = orders_frame(spark, ("a", "y", 2, 2), ("c", "y", 2, 2), ("c", "z", 3, 3))
    absent = merge.insert_absent(t, b, ["order_id"], ["at"]).collect()
    assert [(r.order_id, r.status) for r in absent] == [("c", "z")]
    assert b.join(t, "order_id", "left_semi").select("order_id").distinct().count() + len(absent) == 2


def test_newer_than_an_empty_target_takes_all(spark):
    b = orders_frame(spark, ("a", "x", 1, 1), ("b", "x", 1, 2))
    assert merge.newer_than(b, b.limit(0), "at").count() == 2
    assert merge.newer_than(b, b.filter("at = 1"), "at").count() == 1
