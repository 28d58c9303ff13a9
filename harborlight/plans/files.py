"""File feeds: test tables written as the files the feeds bring, and read back."""

from pyspark.sql import functions as F

from harborlight.operators import orders as ord_ops
from harborlight.oracle import rnd
from harborlight.registry import query
from harborlight.session import run_dir
from harborlight.sources import csv_feeds, layers, sinks


def written(t, df, label, suffix="csv", sep=","):
    """A folder of delimited files with the table's rows."""
    path = f"{run_dir(t.spark, label)}.{suffix}"
    df.write.option("header", True).option("sep", sep).csv(path)
    return path


@query("csv_orders", "A01 B01", f"""
SELECT order_id, CASE WHEN plant <> '' THEN plant ELSE carrier END AS supplier_id, product,
       CASE WHEN l_partkey % 6 <> 0 THEN 'D' || l_suppkey % 9 ELSE 'O' || l_suppkey % 7 END AS region,
       CAST(l_quantity AS INTEGER) AS quantity, {rnd('price', 2)} AS unit_price, {rnd('price * l_quantity', 2)} AS order_value,
       strftime(l_shipdate, '%Y-%m-%d') AS expected_delivery, CAST(greatest(0, l_partkey % 9 - 4) AS INTEGER) AS delay_days,
       CASE WHEN l_partkey % 9 > 4 THEN 'DELAYED' ELSE 'DELIVERED' END AS status, 80.0::DOUBLE AS inventory_level
FROM (SELECT *, l_orderkey || '.' || l_linenumber AS order_id, CASE WHEN l_suppkey % 5 <> 0 THEN 'PLANT' || l_suppkey ELSE '' END AS plant,
        'V' || l_suppkey % 11 AS carrier, 'P' || l_partkey AS product,
        CASE WHEN l_partkey % 8 = 0 OR l_discount = 0 THEN 10.0::DOUBLE ELSE l_discount * 100.0::DOUBLE * 2.5::DOUBLE END AS price
      FROM lineitem WHERE l_partkey % 13 <> 0 AND l_partkey % 17 <> 0)""")
def csv_orders(t):
    """An order list with empty ids, words for numbers, empty cells and zero weights."""
    part, supp = F.col("l_partkey"), F.col("l_suppkey")

    def tag(prefix, n):
        return F.concat(F.lit(prefix), n.cast("string"))

    rows = t.base("lineitem").select(
        F.when(part % 13 != 0, F.concat_ws(".", "l_orderkey", "l_linenumber")).alias("Order_ID"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Order_Date"),
        tag("O", supp % 7).alias("Orig_Port"),
        tag("V", supp % 11).alias("Carrier"),
        F.lit("2").alias("TPT_Day_Count"),
        F.lit("DTD").alias("Service_Level"),
        F.lit("").alias("Ship_Ahead_Day_Count"),
        F.when(part % 17 == 0, "late").otherwise((part % 9 - 4).cast("string")).alias("Ship_Late_Day_Count"),
        F.lit("C").alias("Customer"),
        tag("P", part).alias("Product_ID"),
        F.when(supp % 5 != 0, tag("PLANT", supp)).alias("Plant_Code"),
        F.when(part % 6 != 0, tag("D", supp % 9)).alias("Dest_Port"),
        F.col("l_quantity").cast("string").alias("Unit_Quant"),
        F.when(part % 8 != 0, (F.col("l_discount") * 100.0).cast("string")).alias("Weight"),
    )
    return csv_feeds.orders(t.spark, written(t, rows, "orders")).drop(
        "_source_file", "_source_ingested_at", "created_at", "actual_delivery")


@query("csv_freight", "A02", """
SELECT carrier, orig_port, dest_port, 0.0::DOUBLE AS min_weight, 99.5::DOUBLE AS max_weight, min_cost, mode, transit_days
FROM (SELECT carrier, orig_port, dest_port, min_cost, trim(mode) AS mode, transit_days FROM freight_rates)
WHERE carrier IS NOT NULL AND transit_days <> 7""")
def csv_freight(t):
    days = F.col("transit_days")
    rows = t.freight_rates().select(
        F.col("carrier").alias("Carrier"), F.col("orig_port").alias("Orig_Port"), F.col("dest_port").alias("Dest_Port"),
        F.lit("").alias("Min_Weight_Quant"), F.lit("99.5").alias("Max_Weight_Quant"), F.lit("DTD").alias("Service_Level"),
        F.col("min_cost").cast("string").alias("Min_Cost"), F.lit("0.5").alias("Rate"), F.col("mode").alias("Mode_DSC"),
        F.when(days == 7, "a week").otherwise(days.cast("double").cast("string")).alias("TPT_Day_Count"),
        F.lit("V88").alias("Carrier_Type"))
    return csv_feeds.freight_rates(t.spark, written(t, rows, "freight")).select(
        "carrier", "orig_port", "dest_port", "min_weight", "max_weight", "min_cost", "mode", "transit_days")


@query("csv_warehouses", "A03", """
SELECT s_name AS plant_code, CAST((s_suppkey * 37) % 500 AS INTEGER) AS daily_capacity FROM supplier WHERE s_suppkey % 29 <> 0""")
def csv_warehouses(t):
    rows = t.wh_capacities().select(
        F.col("plant_code").alias("Plant_Code"),
        F.concat(F.col("daily_capacity").cast("string"), F.lit(".6")).alias("Daily_Capacity"))
    return csv_feeds.warehouse_capacities(t.spark, written(t, rows, "warehouses")).select(
        "plant_code", "daily_capacity")


@query("csv_plant_ports", "A04", "SELECT plant_code, port FROM plant_ports WHERE port NOT LIKE '%3'")
def csv_plant_ports(t):
    """A folder whose files order their columns in two ways, and one that lacks a column."""
    rows = t.plant_ports().select(
        F.col("plant_code").alias("Plant_Code"),
        F.when(~F.col("port").endswith("3"), F.col("port")).alias("Ports"))
    half = F.pmod(F.xxhash64("Plant_Code"), F.lit(2))
    path = written(t, rows.filter(half == 0), "ports")
    for more in (rows.filter(half == 1).select("Ports", "Plant_Code"), rows.select("Plant_Code")):
        more.write.mode("append").option("header", True).csv(path)
    return csv_feeds.plant_ports(t.spark, path).select("plant_code", "port")


@query("csv_products", "A05", "SELECT plant_code, product_id FROM products_per_plant WHERE product_id NOT LIKE '%7'")
def csv_products(t):
    rows = t.products_per_plant().select(
        F.col("plant_code").alias("Plant_Code"),
        F.when(~F.col("product_id").endswith("7"), F.col("product_id")).alias("Product_ID"))
    return csv_feeds.products_per_plant(t.spark, written(t, rows, "products")).select("plant_code", "product_id")


@query("csv_any", "A06 B06 B02", f"""
SELECT o_orderkey::VARCHAR AS order_id, 'C' || o_custkey AS supplier_id, 'UNKNOWN' AS region, o_orderpriority AS product,
       CAST(greatest(1, o_custkey % 50) AS INTEGER) AS quantity, {rnd('o_totalprice', 2)} AS order_value, 'PENDING' AS status,
       CAST(o_custkey % 4 AS INTEGER) AS delay_days FROM orders""")
def csv_any(t):
    """A customer's own file: other names, inferred types, then the canonical columns."""
    rows = t.base("orders").select(
        F.col("o_orderkey").alias("PO_Number"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("Vendor"),
        F.col("o_orderpriority").alias("SKU"), (F.col("o_custkey") % 50).alias("Qty"),
        F.lit(1.5).alias("Price"), F.col("o_totalprice").alias("Total"), F.lit("open").alias("State"),
        (F.col("o_custkey") % 4).alias("daysLate"))
    path = written(t, rows, "any", "tsv", "\t")
    table = csv_feeds.any_file(t.spark, path, delimiter="\t")
    return ord_ops.coerce_orders(table, F.lit("2024-01-01")).select(
        "order_id", "supplier_id", "region", "product", "quantity", "order_value", "status", "delay_days")


@query("snapshot_partitions", "A13 A11", """
SELECT CAST(strftime(o_orderdate, '%Y') AS INTEGER) AS year, CAST(strftime(o_orderdate, '%m') AS INTEGER) AS month, count(*) AS n,
       CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1, 2""")
def snapshot_partitions(t):
    """Monthly batches appended under year, month and day."""
    path = run_dir(t.spark, "snapshot")
    sinks.snapshot(t.base("orders"), path, F.date_trunc("MONTH", "o_orderdate"))
    return t.spark.read.parquet(path).groupBy("year", "month").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("new_files_once", "N04", """
SELECT l_returnflag, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM lineitem GROUP BY 1""")
def new_files_once(t):
    """Files arrive in two lots and the loader runs three times."""
    from pyspark.sql import types as T

    base = run_dir(t.spark, "arrivals")
    rows = t.base("lineitem").select("l_orderkey", "l_returnflag")
    schema = T.StructType([T.StructField("l_orderkey", T.LongType()), T.StructField("l_returnflag", T.StringType())])
    odd = rows.filter("l_orderkey % 2 = 1").select("l_returnflag", "l_orderkey")  # another order of columns
    for lot in (rows.filter("l_orderkey % 2 = 0"), odd):
        lot.write.mode("append").option("header", True).csv(f"{base}/in")
        csv_feeds.new_files(t.spark, f"{base}/in", schema, f"{base}/state", f"{base}/out")
    csv_feeds.new_files(t.spark, f"{base}/in", schema, f"{base}/state", f"{base}/out")
    return t.spark.read.parquet(f"{base}/out").groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.sum("l_orderkey").alias("keys"))


@query("compacted", "N05 A12", """
SELECT o_orderstatus, 8 * k AS files_before, k AS files_after, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS keys
FROM orders, (SELECT count(DISTINCT o_orderstatus) AS k FROM orders) GROUP BY ALL""")
def compacted(t):
    """A table in partitions of many small files; one job merges them and the partitions stay."""
    path = run_dir(t.spark, "compact")
    t.base("orders").select("o_orderkey", "o_orderstatus").repartition(8).write.partitionBy("o_orderstatus").parquet(path)
    stats = sinks.compact(t.spark, path)
    return t.spark.read.parquet(path).groupBy("o_orderstatus").agg(
        F.lit(stats["files_before"]).cast("long").alias("files_before"), F.lit(stats["files_after"]).cast("long").alias("files_after"),
        F.count("*").alias("rows"), F.sum("o_orderkey").alias("keys"))


@query("layer_fallback", "A08", """
SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1""")
def layer_fallback(t):
    """No silver table yet: the older text form is read."""
    base = run_dir(t.spark, "layers")
    t.base("orders").select("o_orderkey", "o_orderstatus").write.option("header", True).csv(f"{base}/bronze")
    found = layers.read_first(
        t.spark, [("parquet", f"{base}/silver"), ("csv", f"{base}/bronze")], header=True)
    return found.groupBy("o_orderstatus").agg(F.count("*").alias("n"))
