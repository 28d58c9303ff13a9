import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborlight.session import path_exists, run_dir
from harborlight.sources import csv_feeds, layers, purchase_orders, sinks


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


ORDER_HEAD = ",".join(csv_feeds.ORDER_HEADER)


def test_order_list(spark, tmp_path, rows):
    path = write(
        tmp_path / "OrderList.csv", ORDER_HEAD,
        "1,2013-05-26,PORT09,V44_3,1,CRF,3,0,V1,P1,PLANT16,PORT08,808,14.3",
        "2,2013-05-26,PORT09,V44_3,1,CRF,0,4,V1,P1,,,12.9,0",
        ",2013-05-26,PORT09,V44_3,1,CRF,0,4,V1,P1,,,12,0",
        "3,x,PORT09,V44_3,1,CRF,0,3.0,V1,P1,PLANT16,PORT08,1,1",
        "4,x,PORT09,V44_3,1,CRF,,,V1,P1,PLANT16,PORT08,,",
        "5,x,PORT09,V44_3,1,CRF,a,1,V1,P1,PLANT16,PORT08,1,1",
        "6,x,PORT09,V44_3,1,CRF,1,1,V1,P1,PLANT16,PORT08,many,1",
    )
    got = {r["order_id"]: r for r in rows(csv_feeds.orders(spark, path))}
    assert set(got) == {"1", "2", "4"}
    one, two, four = got["1"], got["2"], got["4"]
    assert (one["supplier_id"], one["region"], one["quantity"], one["unit_price"], one["order_value"], one["status"]) == (
        "PLANT16", "PORT08", 808, 35.75, 28886.0, "DELIVERED")
    assert (two["supplier_id"], two["region"], two["quantity"], two["unit_price"], two["order_value"], two["delay_days"], two["status"]) == (
        "V44_3", "PORT09", 12, 10.0, 120.0, 4, "DELAYED")
    assert (four["quantity"], four["order_value"], four["inventory_level"]) == (0, 0.0, 80.0)
    assert one["_source_file"] == "OrderList.csv"


def test_small_feeds(spark, tmp_path):
    freight = write(tmp_path / "f.csv", ",".join(csv_feeds.FREIGHT_HEADER),
                    "V1,P1,P2,0,99,DTD,4.5,0.7, AIR ,2.9,V88", " ,P1,P2,0,99,DTD,4.5,0.7,AIR,2,V88", "V2,P1,P2,0,99,DTD,x,0.7,AIR,2,V88")
    got = csv_feeds.freight_rates(spark, freight).collect()
    assert [(r.carrier, r.transit_days, r.min_cost, r["mode"]) for r in got] == [("V1", 2, 4.5, "AIR")]
    wh = write(tmp_path / "w.csv", "Plant_Code,Daily_Capacity", "PL1,10.7", ",5", "PL2,", "PL3,x")
    assert {(r.plant_code, r.daily_capacity) for r in csv_feeds.warehouse_capacities(spark, wh).collect()} == {("PL1", 10), ("PL2", 0)}
    ports = write(tmp_path / "p.csv", "Plant_Code,Ports", "PL1,A", "PL1,", ",A")
    assert [(r.plant_code, r.port) for r in csv_feeds.plant_ports(spark, ports).collect()] == [("PL1", "A")]
    products = write(tmp_path / "q.csv", "Plant_Code,Product_ID", "PL1,9", "PL1,")
    assert [(r.plant_code, r.product_id) for r in csv_feeds.products_per_plant(spark, products).collect()] == [("PL1", "9")]


@pytest.mark.parametrize("name,sep", [("a.csv", ","), ("a.tsv", "\t"), ("a.txt", "|")])
def test_any_file_infers_types_and_names(spark, tmp_path, name, sep):
    path = write(tmp_path / name, sep.join(["OrderNumber", "Vendor", "SKU", "Qty", "Price", "My Delay"]),
                 sep.join(["A1", "S", "P", "3", "2.5", "1"]), sep.join(["A2", "S", "P", "4", "3.5", "0"]))
    df = csv_feeds.any_file(spark, path)
    assert df.columns == ["order_id", "supplier_id", "product", "quantity", "unit_price", "My Delay", "_source_file", "_source_ingested_at"]
    assert dict(df.dtypes)["quantity"] == "int" and dict(df.dtypes)["unit_price"] == "double"
    assert df.first()._source_file == name


def test_one_word_among_numbers_is_kept(spark, tmp_path):
    path = write(tmp_path / "n.csv", "Qty,Price", *[f"{i},{i}.5" for i in range(200)], "twelve,1")
    df = csv_feeds.any_file(spark, path)
    assert dict(df.dtypes)["quantity"] == "string" and df.filter("quantity = 'twelve'").count() == 1
    schema = T.StructType([T.StructField("Qty", T.IntegerType()), T.StructField("Price", T.DoubleType())])
    typed = csv_feeds.any_file(spark, path, schema=schema)
    assert typed.filter("quantity IS NOT NULL").count() == 200
    assert [r._bad_cells for r in typed.filter("size(_bad_cells) > 0").collect()] == [["Qty=twelve"]]


def test_columns_go_by_name(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    write(folder / "a.csv", "Plant_Code,Ports", "PL1,A")
    write(folder / "b.csv", "Ports,Plant_Code,Extra", "B,PL2,x")
    write(folder / "c.csv", "Plant_Code", "PL3")
    assert {(r.plant_code, r.port) for r in csv_feeds.plant_ports(spark, str(folder)).collect()} == {("PL1", "A"), ("PL2", "B")}
    got = {tuple(r.asDict().values())[:-2] for r in csv_feeds.any_file(spark, str(folder)).collect()}
    assert got == {("PL1", "A", None), ("PL2", "B", "x"), ("PL3", None, None)}
    schema = T.StructType([T.StructField("Plant_Code", T.StringType()), T.StructField("Ports", T.StringType())])
    csv_feeds.new_files(spark, str(folder), schema, str(tmp_path / "s"), str(tmp_path / "o"))
    got = spark.read.parquet(str(tmp_path / "o")).collect()
    assert {(r.Plant_Code, r.Ports, r._source_file) for r in got} == {
        ("PL1", "A", "a.csv"), ("PL2", "B", "b.csv"), ("PL3", None, "c.csv")}


def test_new_files_are_loaded_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    args = (spark, str(folder), schema, str(tmp_path / "state"), str(tmp_path / "out"))
    write(folder / "one.csv", "a", "1", "2")
    csv_feeds.new_files(*args)
    csv_feeds.new_files(*args)
    write(folder / "two more.csv", "a", "3", "x7")
    csv_feeds.new_files(*args)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.a or 0, r._source_file, tuple(r._bad_cells)) for r in got) == [
        (0, "two%20more.csv", ("a=x7",)), (1, "one.csv", ()), (2, "one.csv", ()), (3, "two%20more.csv", ())]  # names as Spark gives them


def table(spark, *ids, status="DELAYED", at="2024-01-01"):
    return spark.createDataFrame(
        [(i, 1, status, dt.datetime.fromisoformat(at)) for i in ids],
        "order_id string, delay_days int, status string, created_at timestamp_ntz")


def test_read_first_falls_back(spark, tmp_path):
    old = str(tmp_path / "old.csv")
    write(tmp_path / "old.csv", "a", "1")
    choices = [("parquet", str(tmp_path / "silver")), ("csv", old)]
    assert layers.read_first(spark, choices, header=True).count() == 1
    spark.range(3).write.parquet(str(tmp_path / "silver"))
    assert layers.read_first(spark, choices).count() == 3
    with pytest.raises(FileNotFoundError):
        layers.read_first(spark, choices[:0] + [("csv", str(tmp_path / "none"))])


def test_layer_is_built_once_and_again_after_a_change(spark, tmp_path):
    source, built = str(tmp_path / "src"), []
    spark.range(3).write.parquet(source)

    def build():
        built.append(1)
        return spark.read.parquet(source)

    assert layers.materialized(spark, "t", source, build).count() == 3
    assert layers.materialized(spark, "t", source, build).count() == 3 and len(built) == 1
    spark.range(2).write.mode("append").parquet(source)
    assert layers.materialized(spark, "t", source, build).count() == 5 and len(built) == 2


def test_append_replace_and_snapshot(spark):
    path = run_dir(spark, "t")
    sinks.append(table(spark, "a"), path)
    sinks.append(table(spark, "b"), path)
    assert spark.read.parquet(path).count() == 2
    sinks.replace(spark.read.parquet(path).filter("order_id = 'b'"), path)  # reads what it replaces
    assert [r.order_id for r in spark.read.parquet(path).collect()] == ["b"]
    parent = os.path.dirname(path)
    assert not [f for f in os.listdir(parent) if f.startswith(os.path.basename(path) + ".")]

    snap = run_dir(spark, "snap")
    sinks.snapshot(table(spark, "a"), snap, F.lit("2024-03-05").cast("date"))
    sinks.snapshot(table(spark, "b"), snap, F.lit("2024-11-25").cast("date"))
    got = spark.read.option("basePath", snap).parquet(snap).filter("year = 2024 AND month = 11").collect()
    assert [(r.order_id, r.day) for r in got] == [("b", 25)]
    assert path_exists(spark, f"{snap}/year=2024/month=03/day=05")


def test_compaction_keeps_rows(spark):
    path = run_dir(spark, "many")
    spark.range(1000).repartition(12).write.parquet(path)
    stats = sinks.compact(spark, path)
    assert (stats["files_before"], stats["files_after"]) == (12, 1)
    assert spark.read.parquet(path).agg(F.sum("id")).first()[0] == 499500
    assert sinks.compact(spark, path)["files_after"] == 1


def test_compaction_keeps_partitions(spark):
    path = run_dir(spark, "parts")
    rows = spark.range(1000).withColumn("day", F.col("id") % 3)
    rows.repartition(5).write.partitionBy("day").parquet(path)
    before = {r.day: r["count"] for r in spark.read.parquet(path).groupBy("day").count().collect()}
    assert sinks.compact(spark, path)["files_after"] == 3
    one = f"{path}/day=1"
    kept = os.listdir(one)
    spark.range(5).repartition(3).write.mode("append").parquet(f"{path}/day=2")
    assert sinks.compact(spark, path)["files_after"] == 3 and os.listdir(one) == kept
    before[2] += 5
    assert {r.day: r["count"] for r in spark.read.parquet(path).groupBy("day").count().collect()} == before


@pytest.mark.parametrize("broken", [1, 2])
def test_a_rename_that_fails_keeps_the_old_table(spark, monkeypatch, broken):
    path, calls, rename = run_dir(spark, "safe"), [], sinks._rename
    spark.range(3).write.parquet(path)

    def failing(session, source, target):
        calls.append(source)
        return False if len(calls) == broken else rename(session, source, target)

    monkeypatch.setattr(sinks, "_rename", failing)
    with pytest.raises(OSError, match="unchanged"):
        sinks.replace(spark.range(7), path)
    assert spark.read.parquet(path).count() == 3
    monkeypatch.setattr(sinks, "_rename", rename)
    hidden = sinks._hidden(path)
    os.makedirs(hidden, exist_ok=True)
    rename(spark, path, f"{hidden}/old-1234")  # cut off between the renames
    sinks.recover(spark, path)
    assert spark.read.parquet(path).count() == 3 and not os.path.exists(hidden)
    sinks.replace(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7


def files_of(path):
    """Modification times of the data files, by name."""
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_compaction_is_one_job_and_hides_its_drafts(spark, monkeypatch):
    """Two hundred partitions at once; while folders are exchanged, and behind a run that was cut off, no row is seen twice."""
    path = run_dir(spark, "wide")
    rows = spark.range(4000).select("id", F.format_string("%03d", F.col("id") % 200).alias("part"))
    rows.repartition(3).write.partitionBy("part").parquet(path)
    calls, rename, writes = [], sinks._rename, []

    def watched(session, source, target):
        calls.append(target)
        if len(calls) in (1, 2, 250):  # a reader in between
            df = spark.read.parquet(path)
            assert df.count() == df.distinct().count() and set(df.columns) == {"id", "part"}
            writes.append(df.count())
        if len(calls) == 301:
            raise RuntimeError("cut off")
        return rename(session, source, target)

    monkeypatch.setattr(sinks, "_rename", watched)
    with pytest.raises(RuntimeError, match="cut off"):
        sinks.compact(spark, path)
    assert min(writes) >= 4000 - 20  # one folder at most is away
    df = spark.read.parquet(path)
    assert df.count() == df.distinct().count() >= 4000 - 20
    monkeypatch.setattr(sinks, "_rename", rename)
    stats = sinks.compact(spark, path)
    assert stats["files_after"] == 200
    df = spark.read.parquet(path)
    assert df.count() == df.distinct().count() == 4000
    assert not [n for n in os.listdir(path) if n.startswith("_re")] and "part=007" in os.listdir(path)


def test_a_load_touches_its_own_partitions_only(spark):
    path = run_dir(spark, "silver")

    def load(ids, status, at):
        return spark.createDataFrame([(f"o{i}", status, at) for i in ids], "order_id string, status string, at string")

    assert len(sinks.merge_load(load(range(500), "NEW", "1"), path, ["order_id"], ["at"], 16)) == 16
    before = files_of(path)
    touched = sinks.merge_load(load([3, 3, 9999], "DONE", "2"), path, ["order_id"], ["at"], 4)  # keeps its sixteen
    after = files_of(path)
    assert 0 < len(touched) <= 2 and all(t.startswith("hash_16=") for t in touched)
    kept = {f for f in before if not any(f"/{t}/" in f for t in touched)}
    assert kept and all(after[f] == before[f] for f in kept)
    got = {r.order_id: r.status for r in sinks.merged_table(spark, path).collect()}
    assert got == {f"o{i}": "NEW" for i in range(500)} | {"o3": "DONE", "o9999": "DONE"}
    sinks.merge_load(load([5], "MORE", "3").withColumn("extra", F.lit(1)), path, ["order_id"], ["at"])
    found = {r.order_id: r.extra for r in sinks.merged_table(spark, path).collect()}
    assert len(found) == 501 and found["o5"] == 1 and found["o6"] is None
    assert sinks.merge_load(load([], "X", "4"), path, ["order_id"], ["at"]) == []
    assert sinks.merged_table(spark, path).count() == 501


def test_metrics_of_the_batch_job_come_from_its_writes(spark):
    from harborlight.medallion import Medallion

    job = Medallion(spark, run_dir(spark, "job"), F.lit("2024-01-01").cast("timestamp_ntz"))
    job.write("gold/x", spark.range(10).withColumn("delay_days", F.col("id") % 3), F.max("id").alias("most"))
    assert job.metrics["gold/x"] == {"rows": 10, "most": 9}
    assert job.read("gold/x").count() == 10


def test_backfill_modes(spark):
    path = run_dir(spark, "fill")
    order = ["created_at"]
    dry = sinks.backfill(table(spark, "a"), path, "dry_run", order)
    assert not dry["written"] and not dry["failed"] and not path_exists(spark, path)
    assert sinks.backfill(table(spark, "a", "b"), path, "full", order)["written"]
    late = table(spark, "b", "c", status="CANCELLED", at="2024-02-01").unionByName(table(spark, "z", at="2023-01-01"))
    done = sinks.backfill(late, path, "incremental", order, F.lit("2024-01-15").cast("timestamp_ntz"))
    assert done["written"]
    got = {r.order_id: r.status for r in spark.read.parquet(path).collect()}
    assert got == {"a": "DELAYED", "b": "CANCELLED", "c": "CANCELLED"}
    bad = sinks.backfill(table(spark, "q", status="NOPE"), path, "full", order)
    assert bad["failed"] == ["expect_status_in_set"] and not bad["written"]
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(ValueError):
        sinks.backfill(late, path, "other", order)


def po(spark, **changes):
    base = {"id": "1", "orderNumber": "PO-1", "status": "SHIPPED", "estimatedDeliveryDate": "2024-01-05", "daysLate": 0,
            "currentStockLevel": 120.5, "origin": {"id": "S1", "name": "Sup"}, "destination": {"name": "Boston - Main"},
            "orderItems": [{"product": {"productCode": "P1", "name": "Pump"}, "quantity": 4, "unitPrice": 2.5, "totalPrice": 10.0}]}
    body = {k: v for k, v in {**base, **changes}.items() if v != "drop"}
    df = spark.createDataFrame([(json.dumps(body),)], "value string")
    out = purchase_orders.order_events(purchase_orders.flatten(purchase_orders.parse(df, purchase_orders.PURCHASE_ORDER)), F.lit("2024-09-09"))
    return out.first()


def test_purchase_order_event(spark):
    row = po(spark)
    assert (row.order_id, row.supplier_id, row.product, row.region, row.status, row.inventory_level) == (
        "PO-1", "S1", "P1", "Boston", "IN_TRANSIT", 100.0)
    assert row.supplier_health == "NORMAL" and row.causality_chain == "OPENBOXES_IMPORT (source=OPENBOXES)"
    assert po(spark, orderNumber="drop", identifier="I-7").order_id == "I-7"
    assert po(spark, orderNumber="", identifier="drop").order_id == "OB-1"
    assert po(spark, origin="drop") is None
    assert po(spark, origin={"name": "Only name"}).supplier_id == "Only name"
    bare = po(spark, orderItems=[])
    assert (bare.product, bare.quantity, bare.order_value) == ("UNKNOWN", 1, 0.0)
    assert po(spark, orderItems=[{"quantity": 3}]) is None  # an item without a product
    item = {"product": {"name": "Pump"}, "quantity": 4, "unitPrice": 2.5, "totalPrice": 0}
    assert (po(spark, orderItems=[item]).product, po(spark, orderItems=[item]).order_value) == ("Pump", 10.0)
    assert po(spark, daysLate=3).status == "DELAYED" and po(spark, daysLate=7).supplier_health == "CRITICAL"
    assert po(spark, destination="drop").region == "UNKNOWN" and po(spark, estimatedDeliveryDate="drop").expected_delivery == "2024-09-09"


def test_stock_movement(spark):
    body = {"id": "m", "origin": {"name": "A"}, "destination": {"name": "B"},
            "lineItems": [{"product": {"productCode": "P"}, "quantityRequested": 6}]}
    df = spark.createDataFrame([(json.dumps(body),)], "value string")
    row = purchase_orders.flatten_movements(purchase_orders.parse(df, purchase_orders.STOCK_MOVEMENT)).first()
    assert (row.originName, row.destinationName, row.productCode, row.quantityOrdered) == ("A", "B", "P", 6)
