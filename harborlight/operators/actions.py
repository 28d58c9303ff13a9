"""Actions: audit, outcomes, health checks, the autonomy gate, plans, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import rules
from harborlight.functions.numeric import count_if, ratio, round_to

CONFIDENCE_FLOOR = 0.70


def audit(actions: DataFrame, deviations: DataFrame, orders: DataFrame) -> DataFrame:
    """Every action with its deviation and order; missing links leave nulls."""
    dev = deviations.select(
        "deviation_id", F.col("type").alias("deviation_type"), "severity", "order_id")
    return actions.join(dev, "deviation_id", "left").join(
        orders.select("order_id", "supplier_id", "order_value", "product"), "order_id", "left")


def success_rates(actions: DataFrame) -> DataFrame:
    """Outcome per action type; null where nothing is resolved yet."""
    done = F.col("resolved")
    confidence = F.col("confidence").cast("decimal(9,6)")
    return (
        actions.groupBy("action_type")
        .agg(
            F.count("*").alias("total"),
            count_if(done).alias("resolved_count"),
            count_if(done & (F.col("status") != "FAILED")).alias("success_count"),
            F.sum(confidence).cast("double").alias("_sum"),
            F.count("confidence").alias("_n"),
        )
        .select(
            "action_type", "total", "resolved_count", "success_count",
            round_to(ratio(F.col("success_count"), F.col("resolved_count")) * 100, 1).alias("success_rate_pct"),
            round_to(F.coalesce(ratio(F.col("_sum"), F.col("_n")), F.lit(0.0)), 3).alias("avg_confidence"),
        )
    )


def stuck(actions: DataFrame, deviations: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Pending actions older than the limit, with what they are about."""
    limit = now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(minutes))
    waiting = actions.filter((F.col("status") == "PENDING") & (F.col("created_at") < limit)).select(
        "action_id", "deviation_id", "confidence", "created_at")
    return waiting.join(
        deviations.select("deviation_id", F.col("type").alias("deviation_type"), "severity"),
        "deviation_id",
    )


def low_confidence(actions: DataFrame, since: Column, floor: float = 0.4, k: int = 10) -> DataFrame:
    return (
        actions.filter(
            (F.col("status") == "PENDING") & (F.col("confidence") < floor) & (F.col("created_at") > since))
        .orderBy("confidence", "action_id")
        .limit(k)
        .select("action_id", "deviation_id", "confidence", "action_type", "description")
    )


def invalid_reroutes(actions: DataFrame, since: Column) -> DataFrame:
    """Pending reroutes whose payload names no other supplier."""
    named = F.coalesce(F.get_json_object("payload", "$.alternate_supplier_id"), F.lit(""))
    return actions.filter(
        (F.col("action_type") == "REROUTE") & (F.col("status") == "PENDING")
        & (F.col("created_at") > since) & (named == "")
    ).select("action_id", "deviation_id", F.lit("ESCALATE").alias("new_action_type"))


def health(actions: DataFrame, since: Column) -> DataFrame:
    return actions.filter(F.col("created_at") > since).agg(
        count_if(F.col("status") == "PENDING").alias("pending_count"),
        count_if(F.col("status") == "COMPLETED").alias("completed_count"),
        round_to(F.coalesce(
            ratio(F.sum(F.col("confidence").cast("decimal(9,6)")).cast("double"), F.count("confidence")),
            F.lit(0.0)), 3).alias("avg_confidence"),
    )


def gate(actions: DataFrame, deviations: DataFrame, orders: DataFrame, policies: DataFrame,
         floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """Which actions may run by themselves; the others become ESCALATE with a reason.

    First the confidence, then the supplier's policy: severity at or above its
    approval level, or an order value above its cap. No policy means no block.
    """
    def field(name: str) -> Column:
        return F.get_json_object("payload", f"$.{name}")

    linked = (
        actions.withColumn("_confidence", F.coalesce(field("execution_confidence").cast("double"), F.lit(1.0)))
        .withColumn("_severity", F.coalesce(field("severity"), F.lit("MEDIUM")))
        .withColumn("_given", F.coalesce(field("order_value").cast("double"), F.lit(0.0)))
        .join(deviations.select("deviation_id", "order_id"), "deviation_id", "left")
        .join(orders.select("order_id", "supplier_id", "order_value"), "order_id", "left")
        .join(policies, "supplier_id", "left")
        .withColumn("order_value", F.when(F.col("_given") != 0, F.col("_given")).otherwise(
            F.coalesce("order_value", F.lit(0.0))))
    )
    level = F.coalesce(rules.lookup(rules.SEVERITY_RANK, F.col("_severity")), F.lit(0))
    approval = F.coalesce(
        rules.lookup(rules.SEVERITY_RANK, F.col("require_approval_at_severity")), F.lit(3))
    has_policy = F.col("require_approval_at_severity").isNotNull()
    reason = (
        F.when(F.col("action_type") == "ESCALATE", F.lit(None).cast("string"))
        .when(F.col("_confidence") < floor, "CONFIDENCE")
        .when(has_policy & (level >= approval), "SEVERITY")
        .when(has_policy & (F.col("order_value") > F.col("require_approval_above_value")), "VALUE")
    )
    return linked.withColumn("block_reason", reason).withColumn(
        "final_action",
        F.when(F.col("block_reason").isNotNull(), "ESCALATE").otherwise(F.col("action_type")),
    )


def procurement_events(actions: DataFrame) -> DataFrame:
    """Replenishment messages for safety-stock actions; 100 pieces unless stated."""
    def field(name: str) -> Column:
        return F.get_json_object("payload", f"$.{name}")

    return actions.filter(F.col("action_type") == "SAFETY_STOCK").select(
        F.lit("SAFETY_STOCK_TRIGGER").alias("event_type"),
        "deviation_id",
        "description",
        field("severity").alias("severity"),
        field("product").alias("product"),
        F.coalesce(field("recommended_quantity").cast("long"), F.lit(100)).alias("recommended_quantity"),
        F.coalesce(field("financial_impact_usd").cast("double"), F.lit(0.0)).alias("financial_impact_usd"),
    )


def applicable_constraints(orders: DataFrame, constraints: DataFrame) -> DataFrame:
    """Constraints that hold for each order: for all, its supplier, region or product.

    An order names up to four entities. Exploding those and joining on equality
    replaces an OR join. A constraint is met once even if names coincide.
    """
    entities = F.array_distinct(F.array_compact(F.array(
        F.lit("*"), F.col("supplier_id"), F.col("region"), F.col("product"))))
    return orders.withColumn("entity_id", F.explode(entities)).join(constraints, "entity_id")


def violations(matched: DataFrame) -> DataFrame:
    """Rows of matched constraints that the order breaks, with the value seen.

    Expects delay_days, order_value, inventory_level, trust_score and the three
    dates. Limits on entities as a whole and unknown kinds are in ``constraint_report``.
    """
    kind = F.upper("constraint_type")
    upper = (
        F.when(kind == "MAX_DELAY_DAYS", F.col("delay_days").cast("double"))
        .when(kind.isin("MAX_SPEND_USD", "ANOMALY_VALUE_THRESHOLD"), F.col("order_value"))
        .when(kind == "SLA_DELIVERY_DAYS", F.datediff(
            F.coalesce("actual_delivery", "expected_delivery"), "created_at").cast("double"))
    )
    lower = (
        F.when(kind.isin("MIN_TRUST_SCORE", "MIN_TRUST_SCORE_THRESHOLD"), F.col("trust_score"))
        .when(kind.isin("MIN_INVENTORY", "MIN_INVENTORY_LEVEL"), F.col("inventory_level"))
    )
    return matched.withColumn("observed", F.coalesce(upper, lower)).filter(
        F.coalesce(upper > F.col("value"), F.lit(False)) | F.coalesce(lower < F.col("value"), F.lit(False))
    )


ORDER_KINDS = ["MAX_DELAY_DAYS", "MAX_SPEND_USD", "ANOMALY_VALUE_THRESHOLD", "SLA_DELIVERY_DAYS", "MIN_TRUST_SCORE",
               "MIN_TRUST_SCORE_THRESHOLD", "MIN_INVENTORY", "MIN_INVENTORY_LEVEL"]
ENTITY_KINDS = ["MAX_DELAY_RATE_PCT", "MAX_AVG_DELAY_DAYS", "MAX_SINGLE_SUPPLIER_PCT", "MIN_SAFETY_STOCK_DAYS"]


def constraint_report(constraints: DataFrame, orders: DataFrame, broken: DataFrame) -> DataFrame:
    """One row per constraint: its level, the figure seen for an entity as a whole, broken orders, whether it is broken.

    Entities are all orders (*), a supplier, a region or a product. A kind that is
    neither on orders nor on entities is reported as UNKNOWN with no verdict, and so is
    an entity without orders. Days of safety stock are the mean stock over the mean daily demand, from the
    first day with an order to the last one. ``broken`` are the rows of ``violations``.
    """
    kind = F.upper("constraint_type")
    entities = F.array_distinct(F.array_compact(F.array(F.lit("*"), "supplier_id", "region", "product")))
    # counted by entity and supplier first: a hot entity is as many rows as it has suppliers
    pairs = orders.select(
        "supplier_id", "delay_days", F.col("inventory_level").cast("decimal(18,4)").alias("stock"), "quantity",
        F.to_date("created_at").alias("day"), F.explode(entities).alias("entity_id")).groupBy(
        "entity_id", "supplier_id").agg(
        F.count("*").alias("n"), count_if(F.col("delay_days") > 0).alias("late"), F.sum("delay_days").alias("days"),
        F.sum("stock").alias("stock"), F.count("stock").alias("stocked"), F.sum("quantity").alias("demand"),
        F.min("day").alias("first"), F.max("day").alias("last"))
    figures = pairs.groupBy("entity_id").agg(
        F.sum("n").alias("n"), F.sum("late").alias("late"), F.sum("days").alias("days"), F.max("n").alias("most"),
        F.sum("stock").cast("double").alias("stock"), F.sum("stocked").alias("stocked"), F.sum("demand").alias("demand"),
        (F.datediff(F.max("last"), F.min("first")) + 1).alias("span"))
    cover = F.try_divide(F.col("stock") / F.col("stocked") * F.col("span"), F.col("demand").cast("double"))
    counts = broken.groupBy("id").agg(F.count("*").alias("broken_orders"))
    seen = (
        F.when(kind == "MAX_DELAY_RATE_PCT", F.col("late") * F.lit(100.0) / F.col("n"))
        .when(kind == "MAX_AVG_DELAY_DAYS", F.col("days").cast("double") / F.col("n"))
        .when(kind == "MAX_SINGLE_SUPPLIER_PCT", F.col("most") * F.lit(100.0) / F.col("n"))
        .when(kind == "MIN_SAFETY_STOCK_DAYS", cover)
    )
    level = F.when(kind.isin(ORDER_KINDS), "ORDER").when(kind.isin(ENTITY_KINDS), "ENTITY").otherwise("UNKNOWN")
    rows = constraints.join(figures, "entity_id", "left").join(counts, "id", "left").select(
        "id", "constraint_type", level.alias("level"), round_to(seen, 4).alias("observed"),
        F.coalesce("broken_orders", F.lit(0)).alias("broken_orders"), "value")
    return rows.select(
        "id", "constraint_type", "level", "observed", "broken_orders",
        F.when(F.col("level") == "ORDER", F.col("broken_orders") > 0)
        .when(kind == "MIN_SAFETY_STOCK_DAYS", F.col("observed") < F.col("value"))
        .when(F.col("level") == "ENTITY", F.col("observed") > F.col("value")).alias("broken"))
