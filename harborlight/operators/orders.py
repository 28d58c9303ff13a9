"""Order tables: cleaning, staging, facts, listings and timelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.functions import numeric, rules
from harborlight.operators.latest import keep_last

# the order in which later rows of one order id replace earlier ones
ARRIVAL_ORDER = ["expected_delivery", "_k1", "_k2", "order_value"]

# Columns a foreign order table must have.
REQUIRED_ORDER_COLUMNS = [
    "order_id", "supplier_id", "product", "quantity",
    "unit_price", "order_value", "status", "delay_days",
]

CANONICAL_ORDER_COLUMNS = [
    "order_id", "supplier_id", "product", "region", "quantity", "unit_price", "order_value",
    "expected_delivery", "actual_delivery", "delay_days", "status", "inventory_level", "created_at",
]


def silver_orders(raw: DataFrame, order: Sequence[str] = ARRIVAL_ORDER) -> DataFrame:
    """Valid rows, unknown delay as 0, one row per order id."""
    valid = raw.filter(F.trim("order_id") != "").withColumn(
        "delay_days", F.coalesce(F.col("delay_days"), F.lit(0))
    ).filter(F.col("delay_days").between(0, rules.MAX_DELAY_DAYS))
    return keep_last(valid, ["order_id"], order)


def cleaned_orders(raw: DataFrame) -> DataFrame:
    """The stricter, older filter: an unknown delay drops the row, repeats stay."""
    return raw.filter(
        (F.col("order_id") != "")
        & F.col("delay_days").between(0, rules.MAX_DELAY_DAYS)
        & F.col("status").isin(rules.ORDER_STATUSES)
    )


def staged_orders(raw: DataFrame) -> DataFrame:
    return raw.filter(
        (F.col("order_id") != "") & F.col("status").isin(rules.ORDER_STATUSES)
    ).withColumn("delay_days", F.coalesce(F.col("delay_days"), F.lit(0)))


def whole_days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, cut toward zero."""
    return F.extract(F.lit("DAY"), end - start).cast("int")


def with_calculated_delay(staged: DataFrame) -> DataFrame:
    dates_known = F.col("actual_delivery").isNotNull() & F.col("expected_delivery").isNotNull()
    return staged.withColumn(
        "calculated_delay_days",
        F.when(
            dates_known, whole_days_between(F.col("expected_delivery"), F.col("actual_delivery"))
        ).otherwise(F.col("delay_days")),
    )


def shipments(staged: DataFrame) -> DataFrame:
    return with_calculated_delay(staged.filter(F.col("status").isin(rules.SHIPMENT_STATUSES)))


def open_orders(orders: DataFrame) -> DataFrame:
    """Orders still under way, with the looser batch reading as a flag."""
    return orders.filter(F.col("status") != "DELIVERED").withColumn(
        "open_for_api", ~F.col("status").isin(rules.CLOSED_STATUSES)
    )


def missing_order_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED_ORDER_COLUMNS if c not in df.columns]


def rejected_table(df: DataFrame) -> DataFrame:
    """Dead letters of a table that lacks required columns: per source file the missing names and the rows."""
    source = F.col("_source_file") if "_source_file" in df.columns else F.lit(None).cast("string")
    missing = ",".join(missing_order_columns(df))
    rows = df.groupBy(source.alias("source_file")).agg(F.count("*").alias("rows")).filter("rows > 0")
    return rows.select("source_file", F.lit(missing).alias("missing"), "rows") if missing else rows.limit(0).select(
        "source_file", F.lit("").alias("missing"), "rows")


def coerce_orders(df: DataFrame, today: Column) -> DataFrame:
    """Foreign order rows to the canonical columns: defaults, clamps, status fallback.

    A table without the required columns raises; ``rejected_table`` records it.
    Columns of its own stay.
    """
    if missing := missing_order_columns(df):
        raise ValueError(f"required columns are missing: {', '.join(missing)}")

    def text(name: str) -> Column:
        if name not in df.columns:
            return F.lit("UNKNOWN")
        return F.coalesce(F.nullif(F.trim(F.col(name).cast("string")), F.lit("")), F.lit("UNKNOWN"))

    def stamp(name: str, default: Column) -> Column:
        if name not in df.columns:
            return default
        given = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
        return F.coalesce(given, default)

    # each text cell is read once; inline keeps Spark from repeating that per use
    cells = F.struct(
        F.trim(F.col("order_id").cast("string")).alias("_id"),
        F.greatest(F.lit(1), numeric.to_int(F.col("quantity"), 1)).alias("_quantity"),
        F.greatest(F.lit(0.0), numeric.to_double(F.col("unit_price"), 0.0)).alias("_price"),
        numeric.number(F.col("order_value")).alias("_value"),
        F.greatest(F.lit(0), numeric.to_int(F.col("delay_days"), 0)).alias("_delay"),
        F.upper(F.nullif(F.col("status").cast("string"), F.lit(""))).alias("_given_status"),
    )
    rows = df.select("*", F.inline(F.array(cells))).filter(F.col("_id") != "")
    bill = F.col("_price") * F.col("_quantity")
    given_value = F.greatest(F.lit(0.0), F.coalesce("_value", bill))
    value = F.when((given_value == 0) & (F.col("_price") > 0), bill).otherwise(given_value)
    status = F.coalesce(
        "_given_status", F.when(F.col("_delay") > 0, "DELAYED").otherwise("PENDING"))
    inventory = (
        numeric.clamp(numeric.to_double(F.col("inventory_level"), 80.0), 0.0, 100.0)
        if "inventory_level" in df.columns
        else F.lit(80.0)
    )
    return (
        rows.withColumn("_status", status)
        .select(
            F.col("_id").alias("order_id"),
            text("supplier_id").alias("supplier_id"),
            text("product").alias("product"),
            text("region").alias("region"),
            F.col("_quantity").alias("quantity"),
            numeric.round_to("_price", 2).alias("unit_price"),
            numeric.round_to(value, 2).alias("order_value"),
            stamp("expected_delivery", today).alias("expected_delivery"),
            stamp("actual_delivery", F.lit(None).cast("string")).alias("actual_delivery"),
            F.col("_delay").alias("delay_days"),
            F.when(F.col("_status").isin(rules.ORDER_STATUSES), F.col("_status"))
            .otherwise("PENDING").alias("status"),
            inventory.alias("inventory_level"),
            stamp("created_at", today).alias("created_at"),
            *[F.col(f"`{c}`") for c in df.columns if c not in CANONICAL_ORDER_COLUMNS],
        )
    )


# Formats a delivery date may come in, tried in this order.
DATE_FORMATS = [
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "M/d/yy", "dd-MMM-yyyy",
]


def parse_timestamp(value: Column) -> Column:
    """Text in any of the known formats to UTC time; anything else to null."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(value), F.lit(f)) for f in DATE_FORMATS])


def serving_orders(gold: DataFrame, synced_at: Column) -> DataFrame:
    """Gold orders in the shape of the serving table."""
    quantity = F.coalesce(F.col("quantity"), F.lit(1))
    return gold.filter(F.col("order_id").isNotNull()).select(
        "order_id",
        "supplier_id",
        "product",
        "region",
        quantity.alias("quantity"),
        "order_value",
        unit_price(F.col("order_value"), F.col("quantity")).alias("unit_price"),
        F.coalesce(F.col("delay_days"), F.lit(0)).alias("delay_days"),
        F.coalesce(F.col("status"), F.lit("UNKNOWN")).alias("status"),
        F.coalesce(F.col("inventory_level"), F.lit(0.0)).alias("inventory_level"),
        F.coalesce(F.col("expected_delivery"), synced_at).alias("expected_delivery"),
        synced_at.alias("created_at"),
    )


def serving_deviations(gold: DataFrame, synced_at: Column) -> DataFrame:
    """Gold deviations in the shape of the serving table."""
    return gold.select(
        "deviation_id", "order_id", "severity",
        F.coalesce("deviation_type", F.lit("DELAY")).alias("type"),
        synced_at.alias("detected_at"), F.lit(False).alias("executed"), synced_at.alias("created_at"),
    )


def serving_suppliers(risk: DataFrame, synced_at: Column) -> DataFrame:
    """Supplier risk in the shape of the serving table; names and regions are not known there."""
    return risk.select(
        "supplier_id", F.col("supplier_id").alias("name"), F.lit("NA").alias("region"), "trust_score",
        "total_orders", "delayed_orders", "avg_delay_days",
        synced_at.alias("created_at"), synced_at.alias("updated_at"),
    )


def unit_price(value: Column, quantity: Column) -> Column:
    """Value per piece; a quantity of 0 counts as 1."""
    return value / F.when(quantity == 0, 1).otherwise(quantity)


def listing(
    df: DataFrame, order: Sequence[Column], limit: int, offset: int = 0, **equals: object
) -> DataFrame:
    """A filtered, ordered page; parameters that are None do not filter."""
    for name, value in equals.items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    page = df.orderBy(*order)
    return (page.offset(offset) if offset else page).limit(limit)


def timeline(orders: DataFrame, deviations: DataFrame) -> DataFrame:
    """Up to five kinds of life-cycle entries per order.

    The entries an order row itself gives come from one scan; the deviations
    already carry the order id, so no join is needed.
    """
    day = "MMM dd, yyyy"
    lead = F.unix_seconds(F.col("expected_delivery").cast("timestamp")) - F.unix_seconds(
        F.col("created_at").cast("timestamp")
    )
    transit_at = F.col("created_at") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (lead.cast("decimal(18,0)") / 10).cast("decimal(18,6)")
    )

    def entry(kind: str, at: Column, detail: Column, present: Column = F.lit(True)) -> Column:
        return F.when(
            present, F.struct(F.lit(kind).alias("event"), at.alias("at"), detail.alias("detail"))
        )

    late = F.coalesce(F.col("delay_days"), F.lit(0))
    # The names and texts of the entries.
    entries = F.array(
        entry("ORDER_PLACED", F.col("created_at"), F.concat(
            F.lit("Qty: "), F.col("quantity").cast("string"), F.lit(", Product: "), F.col("product"))),
        entry("IN_TRANSIT", transit_at, F.lit("Shipment dispatched from supplier facility"),
              F.col("status").isin(rules.SHIPMENT_STATUSES)),
        entry("EXPECTED_DELIVERY", F.col("expected_delivery"),
              F.concat(F.lit("Original SLA: "), F.date_format("expected_delivery", day))),
        entry("DELIVERED", F.col("actual_delivery"),
              F.concat(F.lit("Delivered "), F.date_format("actual_delivery", day),
                       F.when(late == 0, " (on time)").otherwise(
                           F.concat(F.lit(" ("), late.cast("string"), F.lit("d late)")))),
              (F.col("status") == "DELIVERED") & F.col("actual_delivery").isNotNull()),
        entry("DELAY_CONFIRMED", F.col("expected_delivery"),
              F.concat(F.lit("Delayed by "), late.cast("string"), F.lit(" days")),
              F.col("status") == "DELAYED"),
    )
    own = orders.select(
        "order_id", F.inline(F.filter(entries, lambda e: e.isNotNull()))
    )
    # Prefix and texts of the deviation entries.
    found = deviations.select(
        "order_id",
        F.concat(F.lit("DEVIATION_"), F.col("type")).alias("event"),
        F.col("detected_at").alias("at"),
        F.concat(F.lit("Severity: "), F.col("severity"), F.lit(", "),
                 F.coalesce(F.col("recommended_action"), F.lit("Investigation required"))).alias("detail"),
    )
    return own.unionByName(found)
