"""Business rules as column expressions.

The numbers, names and word lists here are fixed values: results depend on
them, so they are stated once, in plain text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harborlight.functions.numeric import clamp, round_to

# Order statuses.
ORDER_STATUSES = ["PENDING", "IN_TRANSIT", "DELIVERED", "DELAYED", "CANCELLED"]
SHIPMENT_STATUSES = ["DELIVERED", "DELAYED", "IN_TRANSIT"]
SUITE_STATUSES = ORDER_STATUSES + ["CRF", "DTD"]
CLOSED_STATUSES = ["DELIVERED", "CANCELLED"]
MAX_DELAY_DAYS = 365

# Status names of the purchase-order system and ours.
EXTERNAL_STATUS = {
    "PENDING": "PENDING",
    "PLACED": "PENDING",
    "PARTIALLY_RECEIVED": "IN_TRANSIT",
    "RECEIVED": "DELIVERED",
    "SHIPPED": "IN_TRANSIT",
    "COMPLETED": "DELIVERED",
    "CANCELLED": "CANCELLED",
    "REJECTED": "CANCELLED",
    "ROLLBACK": "CANCELLED",
    "CHECKING": "IN_TRANSIT",
    "DELIVERING": "IN_TRANSIT",
}

# Severities from low to high.
SEVERITY_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}


def lookup(mapping: dict[str, object], key: Column) -> Column:
    """Value of a fixed table for a key; null for an unknown key."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def is_late(delay: Column) -> Column:
    """Late orders; an unknown delay counts as not late."""
    return F.coalesce(delay > 0, F.lit(False))


def delay_severity(delay: Column) -> Column:
    return (
        F.when(delay > 14, "CRITICAL").when(delay > 7, "HIGH").when(delay > 0, "MEDIUM")
    )


def canonical_status(external: Column, delay: Column) -> Column:
    """Outside status name to ours; any delay wins unless the order is cancelled."""
    known = F.coalesce(lookup(EXTERNAL_STATUS, external), F.lit("PENDING"))
    return F.when((delay > 0) & (known != "CANCELLED"), "DELAYED").otherwise(known)


def health_bucket(delay: Column) -> Column:
    return F.when(delay == 0, "NORMAL").when(delay < 7, "DEGRADING").otherwise("CRITICAL")


def region_prefix(location: Column) -> Column:
    """The text before " - " of a location name."""
    return F.trim(F.split(location, " - ")[0])


def carrying_cost(value: Column, delay: Column) -> Column:
    """2 % of the order value per 30 days of delay."""
    return F.when(delay > 0, value * (delay / F.lit(30.0)) * F.lit(0.02)).otherwise(0.0)


def delay_cost(delay: Column) -> Column:
    return delay * F.lit(500.0)


def stockout_penalty(value: Column, kind: Column) -> Column:
    return F.when(F.upper(kind) == "STOCKOUT", value * F.lit(0.15)).otherwise(0.0)


def alert_cost(value: Column, delay: Column) -> Column:
    """2 % of the order value per day of delay."""
    return round_to(delay.cast("double") * value * F.lit(0.02), 2)


def cost_tier(cost: Column) -> Column:
    return (
        F.when(cost >= 10000, "CRITICAL_COST").when(cost >= 2000, "HIGH_COST").otherwise("MODERATE")
    )


def concentration_bucket(share_pct: Column) -> Column:
    return F.when(share_pct >= 70, "HIGH").when(share_pct >= 40, "MEDIUM").otherwise("LOW")


def trust_score(late: Column, total: Column) -> Column:
    """1 minus half the share of late orders."""
    share = late.cast("double") / F.greatest(total, F.lit(1)).cast("double")
    return clamp(F.lit(1.0) - share * F.lit(0.5), 0.0, 1.0)


def late_pct(late: Column, total: Column) -> Column:
    return late.cast("double") / F.greatest(total, F.lit(1)).cast("double") * F.lit(100.0)


def level_of(probability: Column, high: str, middle: str, low: str) -> Column:
    return F.when(probability >= 0.75, high).when(probability >= 0.5, middle).otherwise(low)


def heuristic_probability(inventory: Column, value: Column, quantity: Column) -> Column:
    """Delay probability without a model: three additive signals."""
    score = (
        F.when(inventory < 100, 0.3).otherwise(0.0)
        + F.when(value > 10000, 0.2).otherwise(0.0)
        + F.when(quantity > 500, 0.15).otherwise(0.0)
    )
    return round_to(F.least(score, F.lit(0.95)), 4)


def money_text(value: Column) -> Column:
    """12345.6 as 12,345.60."""
    return F.format_number(value.cast("decimal(18,2)"), 2)


def delay_action_text(supplier: Column, delay: Column) -> Column:
    return F.concat(
        F.lit("Escalate to supplier "), supplier, F.lit(": order delayed "),
        delay.cast("string"), F.lit(" days"),
    )


def restock_action_text(product: Column, inventory: Column) -> Column:
    verb = F.when(inventory < 5, "Emergency restock for ").otherwise("Schedule restock for ")
    level = inventory.cast("decimal(18,1)").cast("string")
    return F.concat(verb, product, F.lit(" \u2014 inventory at "), level, F.lit("%"))


def anomaly_action_text(value: Column, supplier: Column) -> Column:
    return F.concat(
        F.lit("Review unusually high order value $"), money_text(value), F.lit(" from "), supplier
    )
