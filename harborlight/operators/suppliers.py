"""Supplier tables: risk, dimension, costs, benchmarks, concentration, scorecards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.functions.numeric import count_if, money_sum, ratio, round_to
from harborlight.operators.latest import top_per_key
from harborlight.operators.ranking import global_rank


def supplier_risk(orders: DataFrame) -> DataFrame:
    """Order count, late orders, mean delay, trust and late share per supplier."""
    late = rules.is_late(F.col("delay_days"))
    return (
        orders.filter(F.col("supplier_id").isNotNull())
        .groupBy("supplier_id")
        .agg(
            F.count("*").alias("total_orders"),
            count_if(late).alias("delayed_orders"),
            ratio(F.sum("delay_days"), F.count("delay_days")).alias("avg_delay_days"),
        )
        .withColumn("trust_score", rules.trust_score(F.col("delayed_orders"), F.col("total_orders")))
        .withColumn("delay_rate_pct", rules.late_pct(F.col("delayed_orders"), F.col("total_orders")))
    )


def staged_suppliers(suppliers: DataFrame) -> DataFrame:
    return suppliers.filter(F.col("supplier_id").isNotNull()).select(
        "supplier_id",
        "name",
        "region",
        F.coalesce("trust_score", F.lit(1.0)).alias("trust_score"),
        F.coalesce("total_orders", F.lit(0)).cast("long").alias("total_orders"),
        F.coalesce("delayed_orders", F.lit(0)).cast("long").alias("delayed_orders"),
        F.coalesce("avg_delay_days", F.lit(0.0)).alias("avg_delay_days"),
    )


def gold_orders(orders_with_flags: DataFrame, risk: DataFrame) -> DataFrame:
    """Orders with the statistics of their supplier."""
    return orders_with_flags.join(risk.drop("delay_rate_pct"), "supplier_id", "left")


def supplier_dimension(staged_suppliers: DataFrame, staged_orders: DataFrame) -> DataFrame:
    """Suppliers with order counts.

    Orders are counted per supplier before the join, so the join meets one row
    per supplier and a supplier with most of the orders makes no large group.
    """
    counts = staged_orders.groupBy("supplier_id").agg(
        F.count("order_id").alias("order_count"),
        count_if(F.col("delay_days") > 0).alias("delayed_count"),
    )
    pct = F.when(
        F.col("order_count") > 0,
        round_to(F.lit(100.0) * F.col("delayed_count") / F.col("order_count"), 2),
    ).otherwise(0.0)
    return (
        staged_suppliers.join(counts, "supplier_id", "left")
        .fillna(0, ["order_count", "delayed_count"])
        .withColumn("delay_rate_pct", pct)
    )


def cost_analytics(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Spend, delay cost and efficiency per supplier, largest spend first."""
    late = F.col("delay_days") > 0
    # a tenth of a percent of the value per late day, added up in exact 1/100000 units
    cost = F.when(
        late, F.col("order_value").cast("decimal(18,2)") * F.col("delay_days") * F.lit("0.001").cast("decimal(4,3)")
    )
    sums = orders.groupBy("supplier_id").agg(
        F.count("*").alias("total_orders"),
        money_sum("order_value").alias("total_spend"),
        F.sum(cost).cast("double").alias("_delay_cost"),
        F.sum(F.when(late, F.col("delay_days"))).alias("_late_days"),
        count_if(late).alias("_late"),
        count_if(F.col("status") == "DELAYED").alias("delayed_count"),
    )
    spend = F.coalesce("total_spend", F.lit(0.0))
    delay_cost = F.coalesce("_delay_cost", F.lit(0.0))
    total = F.col("total_orders")
    return sums.join(suppliers.select("supplier_id", "name", "region"), "supplier_id", "left").select(
        "supplier_id",
        F.coalesce("name", "supplier_id").alias("name"),
        F.coalesce("region", F.lit("Unknown")).alias("region"),
        "total_orders",
        round_to(spend, 2).alias("total_spend"),
        round_to(ratio(spend, total), 2).alias("avg_order_value"),
        round_to(ratio(F.col("_late_days"), F.col("_late")), 2).alias("avg_delay_days_when_delayed"),
        "delayed_count",
        round_to(ratio(F.col("delayed_count"), total) * 100, 1).alias("delay_rate_pct"),
        round_to(delay_cost, 2).alias("estimated_delay_cost_usd"),
        F.when(
            spend > 0,
            round_to(F.greatest(F.lit(0.0), 1 - F.try_divide(delay_cost, spend)) * 100, 1),
        ).otherwise(100.0).alias("cost_efficiency_score"),
    )


def benchmarks(orders: DataFrame, suppliers: DataFrame, product: str | None = None) -> DataFrame:
    """Delivery benchmark per supplier with a composite score and a global rank.

    The mean order value is the true mean over the supplier's orders.
    """
    if product:
        orders = orders.filter(F.contains(F.lower("product"), F.lit(product.lower())))
    per_product = orders.groupBy("supplier_id", "product").agg(
        F.count("*").alias("n"),
        F.sum("delay_days").alias("delay_sum"),
        count_if(F.col("status") == "DELAYED").alias("delayed"),
        count_if(F.col("status") == "DELIVERED").alias("delivered"),
        F.sum(F.col("order_value").cast("decimal(18,2)")).alias("value"),
    )
    total = F.sum("n")
    rolled = per_product.groupBy("supplier_id").agg(
        total.alias("total_orders"),
        F.sum("delayed").alias("delayed_count"),
        F.sum("delivered").alias("delivered_count"),
        F.count("product").alias("product_count"),
        round_to(ratio(F.sum("delay_sum"), total), 2).alias("avg_delay_days"),
        round_to(ratio(F.sum("value").cast("double"), total), 2).alias("avg_order_value"),
    )
    rate = ratio(F.col("delayed_count"), F.col("total_orders")) * 100
    scored = rolled.join(
        suppliers.select("supplier_id", "name", "region", "trust_score"), "supplier_id", "left"
    ).select(
        "supplier_id",
        F.coalesce("name", "supplier_id").alias("name"),
        F.coalesce("region", F.lit("Unknown")).alias("region"),
        F.coalesce("trust_score", F.lit(0.0)).alias("trust_score"),
        "total_orders",
        "delayed_count",
        "delivered_count",
        "product_count",
        "avg_delay_days",
        "avg_order_value",
        round_to(rate, 1).alias("delay_rate_pct"),
        round_to(100 - rate, 1).alias("on_time_rate_pct"),
        round_to(F.coalesce("trust_score", F.lit(0.0)) * (100 - rate), 1).alias("composite_score"),
    )
    return global_rank(scored, [F.col("composite_score").desc(), F.col("supplier_id").asc()], "rank")


def concentration(orders: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Largest share of one product's orders that a supplier holds."""
    pairs = orders.groupBy("supplier_id", "product").agg(F.count("*").alias("n"))
    totals = pairs.groupBy("product").agg(F.sum("n").alias("product_total"))
    share = (
        pairs.join(totals, "product")
        .groupBy("supplier_id")
        .agg(F.max(ratio(F.col("n"), F.col("product_total")) * 100).alias("_share"))
    )
    pct = round_to(F.coalesce("_share", F.lit(0.0)), 1)
    total, late = F.coalesce("total_orders", F.lit(0)), F.coalesce("delayed_orders", F.lit(0))
    return suppliers.join(share, "supplier_id", "left").select(
        "supplier_id",
        "name",
        "region",
        "trust_score",
        total.alias("total_orders"),
        late.alias("delayed_orders"),
        F.coalesce(ratio(late, total) * 100, F.lit(0.0)).alias("delay_rate_pct"),
        pct.alias("max_product_dependency_pct"),
        rules.concentration_bucket(pct).alias("concentration_risk"),
    )


def scorecard(
    suppliers: DataFrame, orders: DataFrame, deviations: DataFrame, today: Column, weeks: int = 12
) -> DataFrame:
    """Weekly figures for the last weeks, empty weeks included.

    The week number is arithmetic on the date, so the range join becomes an
    equality join on (supplier, week).
    """

    def week_of(stamp: str) -> Column:
        return F.floor(F.datediff(today, F.col(stamp)) / 7).cast("int")

    def recent(df: DataFrame, stamp: str) -> DataFrame:
        return df.withColumn("_week", week_of(stamp)).filter(
            (F.datediff(today, F.col(stamp)) >= 0) & (F.col("_week") < weeks)
        )

    by_order = recent(orders, "created_at").groupBy("supplier_id", "_week").agg(
        F.count("*").alias("total_orders"),
        count_if(F.col("delay_days") > 0).alias("_late"),
        F.sum("delay_days").alias("_delay"),
    )
    by_deviation = recent(deviations, "detected_at").groupBy("supplier_id", "_week").agg(
        F.count("*").alias("deviation_count")
    )
    calendar = suppliers.select(
        "supplier_id", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("_week")
    )
    total = F.col("total_orders")
    return (
        calendar.join(by_order, ["supplier_id", "_week"], "left")
        .join(by_deviation, ["supplier_id", "_week"], "left")
        .select(
            "supplier_id",
            F.date_format(F.date_sub(today.cast("date"), F.col("_week") * 7), "yyyy-MM-dd").alias("week"),
            F.coalesce(total, F.lit(0)).alias("total_orders"),
            round_to(ratio(total - F.col("_late"), total) * 100, 1).alias("on_time_pct"),
            F.coalesce(round_to(ratio(F.col("_delay"), total), 1), F.lit(0.0)).alias("avg_delay_days"),
            F.coalesce("deviation_count", F.lit(0)).alias("deviation_count"),
        )
    )


def product_mix(orders: DataFrame, k: int = 5, shift_pct: float | None = None) -> DataFrame:
    """The k most ordered products per supplier, optionally with a volume shift applied."""
    mix = orders.groupBy("supplier_id", "product").agg(
        F.count("*").alias("orders"), money_sum("order_value").alias("total_value")
    )
    top = top_per_key(mix, ["supplier_id"], [F.col("orders").desc(), F.col("product").asc()], k, "rank")
    if shift_pct is None:
        return top
    return top.withColumn("shifted_value", round_to(F.col("total_value") * (shift_pct / 100.0), 2))


def merge_statistics(current: DataFrame, batch: DataFrame) -> DataFrame:
    """Running supplier statistics after one batch of orders."""
    delta = batch.groupBy("supplier_id").agg(
        F.count("*").alias("_n"),
        count_if(F.col("delay_days") > 0).alias("_late"),
        F.sum("delay_days").alias("_delay"),
    )
    added, late = F.coalesce("_n", F.lit(0)), F.coalesce("_late", F.lit(0))
    total = F.col("total_orders") + added
    mean = F.when(F.col("_n").isNull(), F.col("avg_delay_days")).otherwise(
        (F.col("avg_delay_days") * F.col("total_orders") + F.coalesce("_delay", F.lit(0)))
        / F.greatest(total, F.lit(1))
    )
    trust = F.when(F.col("_n").isNull(), F.col("trust_score")).otherwise(
        rules.trust_score(F.col("delayed_orders") + late, total)
    )
    return current.join(delta, "supplier_id", "left").select(
        "supplier_id",
        total.alias("total_orders"),
        (F.col("delayed_orders") + late).alias("delayed_orders"),
        mean.alias("avg_delay_days"),
        trust.alias("trust_score"),
    )


def best_alternates(suppliers: DataFrame, min_trust: float, k: int) -> DataFrame:
    """Per region the k + 1 most trusted suppliers as one short array.

    One more than needed, so that a supplier can be taken out of its own list.
    """
    ranked = top_per_key(
        suppliers.filter(F.col("trust_score") >= min_trust),
        ["region"],
        [F.col("trust_score").desc(), F.col("supplier_id").asc()],
        k + 1,
    )
    return ranked.groupBy("region").agg(
        F.sort_array(F.collect_list(F.struct(
            "_rank", F.col("supplier_id").alias("alt_supplier_id"),
            F.col("trust_score").alias("alt_trust_score"),
        ))).alias("_best")
    )


def alternates_for(orders: DataFrame, suppliers: DataFrame, min_trust: float, k: int) -> DataFrame:
    """Each order with up to k other suppliers of its region."""
    best = best_alternates(suppliers, min_trust, k)
    others = F.slice(
        F.filter("_best", lambda s: s.alt_supplier_id != F.col("supplier_id")), 1, k
    )
    return orders.join(best, "region").select(
        *orders.columns, F.posexplode(others).alias("_pos", "_alt")
    ).select(
        *orders.columns,
        (F.col("_pos") + 1).alias("alt_rank"),
        "_alt.alt_supplier_id",
        "_alt.alt_trust_score",
    )


def co_affected(orders: DataFrame, open_orders: DataFrame, k: int = 5) -> DataFrame:
    """Each order with up to k other open orders of its supplier, earliest due first."""
    first = top_per_key(
        open_orders, ["supplier_id"],
        [F.col("expected_delivery").asc(), F.col("order_id").asc()], k + 1,
    ).groupBy("supplier_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "_rank", F.col("order_id").alias("co_order_id"), F.col("status").alias("co_status"),
            F.col("expected_delivery").alias("co_due"),
        ))).alias("_first")
    )
    others = F.slice(F.filter("_first", lambda o: o.co_order_id != F.col("order_id")), 1, k)
    return orders.join(first, "supplier_id").select(
        *orders.columns, F.posexplode(others).alias("_pos", "_co")
    ).select(
        *orders.columns, (F.col("_pos") + 1).alias("co_rank"),
        "_co.co_order_id", "_co.co_status", "_co.co_due",
    )
