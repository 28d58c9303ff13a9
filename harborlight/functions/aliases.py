"""Foreign field names to ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Field name -> canonical field name.
FIELD_ALIASES = {
    "order_number": "order_id",
    "po_number": "order_id",
    "purchase_order": "order_id",
    "po": "order_id",
    "order": "order_id",
    "vendor": "supplier_id",
    "vendor_id": "supplier_id",
    "supplier": "supplier_id",
    "plant": "supplier_id",
    "plant_code": "supplier_id",
    "manufacturer": "supplier_id",
    "mfr": "supplier_id",
    "sku": "product",
    "item": "product",
    "part_number": "product",
    "part_no": "product",
    "item_id": "product",
    "product_id": "product",
    "material": "product",
    "destination": "region",
    "dest": "region",
    "dest_port": "region",
    "ship_to": "region",
    "delivery_location": "region",
    "location": "region",
    "country": "region",
    "market": "region",
    "qty": "quantity",
    "units": "quantity",
    "unit_quant": "quantity",
    "pieces": "quantity",
    "count": "quantity",
    "volume": "quantity",
    "price": "unit_price",
    "cost": "unit_price",
    "rate": "unit_price",
    "unit_cost": "unit_price",
    "total": "order_value",
    "total_value": "order_value",
    "amount": "order_value",
    "invoice_amount": "order_value",
    "delivery_date": "expected_delivery",
    "due_date": "expected_delivery",
    "eta": "expected_delivery",
    "promised_date": "expected_delivery",
    "ship_date": "expected_delivery",
    "actual_delivery_date": "actual_delivery",
    "received_date": "actual_delivery",
    "delivery_actual": "actual_delivery",
    "days_late": "delay_days",
    "lateness": "delay_days",
    "overdue_days": "delay_days",
    "ship_late_day_count": "delay_days",
    "state": "status",
    "order_status": "status",
    "shipment_status": "status",
    "stock": "inventory_level",
    "stock_level": "inventory_level",
    "on_hand": "inventory_level",
    "available_qty": "inventory_level",
    "inventory": "inventory_level",
    "orderNumber": "order_id",
    "identifier": "order_id",
    "po_ref": "order_id",
    "purchase_order_no": "order_id",
    "docname": "order_id",
    "originName": "supplier_id",
    "originId": "supplier_id",
    "supplier_name": "supplier_id",
    "vendor_code": "supplier_id",
    "party": "supplier_id",
    "productCode": "product",
    "productName": "product",
    "item_code": "product",
    "item_name": "product",
    "part_code": "product",
    "article_number": "product",
    "destinationName": "region",
    "set_warehouse": "region",
    "warehouse": "region",
    "delivery_warehouse": "region",
    "ship_to_location": "region",
    "totalPrice": "order_value",
    "grand_total": "order_value",
    "net_total": "order_value",
    "rounded_total": "order_value",
    "unitPrice": "unit_price",
    "base_rate": "unit_price",
    "price_list_rate": "unit_price",
    "quantityOrdered": "quantity",
    "quantityRequested": "quantity",
    "ordered_qty": "quantity",
    "received_qty": "quantity",
    "pending_qty": "quantity",
    "estimatedDeliveryDate": "expected_delivery",
    "schedule_date": "expected_delivery",
    "required_date": "expected_delivery",
    "dateReceived": "actual_delivery",
    "transaction_receipt_date": "actual_delivery",
    "lr_date": "actual_delivery",
    "daysLate": "delay_days",
    "delay_in_days": "delay_days",
    "days_overdue": "delay_days",
    "late_days": "delay_days",
    "workflow_state": "status",
    "document_status": "status",
    "fulfillment_status": "status",
    "currentStockLevel": "inventory_level",
    "quantityOnHand": "inventory_level",
    "actual_qty": "inventory_level",
    "projected_qty": "inventory_level",
    "in_stock_qty": "inventory_level",
}

MIN_PARTIAL = 4


def tidy(name: Column) -> Column:
    return F.lower(F.trim(name))


def exact_target(name: Column) -> Column:
    """Canonical name of a field that is a known alias, whatever its case."""
    pairs = [F.lit(x) for alias, target in FIELD_ALIASES.items() for x in (alias.lower(), target)]
    return F.try_element_at(F.create_map(*pairs), tidy(name))


def partial_target(name: Column) -> Column:
    """Canonical name of a field that is part of aliases which all mean one thing.

    Names and aliases under four letters do not take part; a name that fits
    aliases of two canonical fields stays unmapped.
    """
    aliases = F.array(*[
        F.struct(F.lit(alias.lower()).alias("alias"), F.lit(target).alias("target"))
        for alias, target in FIELD_ALIASES.items() if len(alias) >= MIN_PARTIAL
    ])
    short = tidy(name)
    targets = F.array_distinct(F.transform(
        F.filter(aliases, lambda a: F.contains(a["alias"], short)), lambda a: a["target"]))
    return F.when((F.length(short) >= MIN_PARTIAL) & (F.size(targets) == 1), targets[0])


def map_fields(fields: DataFrame, name: str = "field_name") -> DataFrame:
    """Rows of field names with canonical name and how it was found.

    Names repeat a lot, so each distinct one is resolved once and joined back.
    """
    known = fields.select(name).distinct().select(
        name, exact_target(F.col(name)).alias("_exact"), partial_target(F.col(name)).alias("_partial"))
    resolved = known.select(
        name,
        F.coalesce("_exact", "_partial").alias("canonical"),
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_partial").isNotNull(), "partial")
        .otherwise("unmapped").alias("match"),
    )
    return fields.join(resolved, name, "left")


def rename_known(df: DataFrame) -> DataFrame:
    """A wide table with its known columns renamed; the first of two claimants wins."""
    lower = {alias.lower(): target for alias, target in FIELD_ALIASES.items()}
    taken = {c.lower() for c in df.columns if c.lower() in set(FIELD_ALIASES.values())}
    names = []
    for c in df.columns:
        key = c.strip().lower()
        target = lower.get(key)
        if target is None and len(key) >= MIN_PARTIAL and key not in taken:
            found = {t for a, t in lower.items() if len(a) >= MIN_PARTIAL and key in a}
            target = found.pop() if len(found) == 1 else None
        if target is None or target in taken:
            names.append(c)
        else:
            taken.add(target)
            names.append(target)
    return df.toDF(*names)
