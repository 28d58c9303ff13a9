"""Layers written in waves: the rows of one wave, one file for each bucket, and nothing left of the shuffles."""

import datetime
import glob

import pytest

from harborlight.sources import layers, sinks
from harborlight.sources.derived import Tables


def folder_of_orders(spark, path):
    """Order tables with repeated and missing keys; line items repeat too."""
    day = datetime.datetime(2024, 1, 1)
    at = lambda k: day + datetime.timedelta(days=k)
    tables = {
        "region": ([(0, "ASIA"), (1, "EUROPE")], "r_regionkey int, r_name string"),
        "nation": ([(k, f"nation{k}", k % 2) for k in range(4)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(k, k % 4) for k in range(9)], "c_custkey long, c_nationkey int"),
        "supplier": ([(k, f"S{k}", k % 4, 1.0 * k) for k in range(7)] + [(3, "S3 too", None, 0.0)],
                     "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "part": ([(k, f"part{k % 5}", f"b{k % 3}") for k in range(40)], "p_partkey long, p_name string, p_brand string"),
        "orders": ([(k if k % 11 else None, k % 9, "FOP"[k % 3], at(k % 50)) for k in range(120)] + [(5, 5, "F", at(5))],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz"),
        "lineitem": ([(k % 120 if k % 13 else None, k % 43, k % 8, k % 4, 1.0 + k % 3, 10.0 + k, "AR"[k % 2], at(k % 90))
                      for k in range(900)] * 2,
                     "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                     "l_returnflag string, l_shipdate timestamp_ntz"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def shuffle_files(spark):
    env = spark._jvm.org.apache.spark.SparkEnv.get()
    return {f for d in env.blockManager().diskBlockManager().localDirs() for f in glob.glob(f"{d}/*/shuffle_*.data")}


@pytest.fixture
def waves(monkeypatch):
    monkeypatch.setattr(layers, "WAVE_BYTES", 1)
    monkeypatch.setattr(layers, "MOST_WAVES", 3)


def test_shares_of_raw_orders(spark, tmp_path, waves):
    """The parts of the raw orders are disjoint, and together all of them; null and repeated keys among them."""
    t = Tables(spark, folder_of_orders(spark, tmp_path / "in"))
    every = sorted(map(str, t.raw_orders().collect()))
    parts = [[str(r) for r in t.raw_orders(share=(k, 3)).collect()] for k in range(3)]
    assert all(parts) and sorted(sum(parts, [])) == every
    assert sorted(map(str, t.bronze_orders().collect())) == every


def test_silver_in_waves(spark, tmp_path, waves, monkeypatch):
    """Silver has the same rows in waves; each bucket is one file, no bronze layer is written for it and no shuffle files stay."""
    folder = folder_of_orders(spark, tmp_path / "in")
    t = Tables(spark, folder)
    before = shuffle_files(spark)
    silver = t.silver_orders()
    assert shuffle_files(spark) <= before
    assert not layers.built(spark, "bronze_orders", t.folder, t.state)
    parts = layers.bucket_count(spark, t.state)
    assert parts == 3 * spark.sparkContext.defaultParallelism
    files = silver.inputFiles()
    buckets = [f.split("_")[-1].split(".")[0] for f in files]
    assert len(set(buckets)) == len(buckets) <= parts
    # columns in which rows that replace each other agree are the same whichever of them stays
    columns = ["order_id", "expected_delivery", "_k1", "_k2", "order_value"]
    found = sorted(map(str, silver.select(columns).collect()))
    monkeypatch.undo()
    again = Tables(spark, folder_of_orders(spark, tmp_path / "again"))
    again.bronze_orders()
    assert found == sorted(map(str, again.silver_orders().select(columns).collect()))
    assert len(found) == len({r.order_id for r in silver.select("order_id").collect()}) > 100


def test_settings_come_back(spark, tmp_path, waves):
    """A layer that cannot be built leaves the session's settings as they were, and can be built later."""
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError):
        layers.materialized(spark, "t", source, lambda: (_ for _ in ()).throw(RuntimeError("no")), bucket_by="id")
    assert spark.conf.get("spark.sql.shuffle.partitions") == was
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert layers.materialized(spark, "t", source, lambda: spark.read.parquet(source), bucket_by="id").count() == 5


def test_merge_and_compact_in_runs(spark, tmp_path, waves):
    """A load is merged and its table compacted a run of folders at a time, with the rows and files of one run."""
    path = str(tmp_path / "t")
    rows = lambda lo, hi, v: spark.range(lo, hi).selectExpr("id", f"{v} v", "id % 7 w").repartition(4)
    assert len(sinks.merge_load(rows(0, 400, 1), path, ["id"], ["v"], 8)) == 8
    assert len(sinks.merge_load(rows(300, 500, 2), path, ["id"], ["v"], 8)) == 8
    found = {r.id: r.v for r in sinks.merged_table(spark, path).collect()}
    assert found == {k: 2 if k >= 300 else 1 for k in range(500)} and sinks.merged_table(spark, path).count() == 500
    spark.read.parquet(path).repartition(5).write.mode("append").partitionBy("hash_8").parquet(path)
    jobs = []
    kept = sinks.wave_count
    with pytest.MonkeyPatch.context() as m:
        m.setattr(sinks, "wave_count", lambda size: jobs.append(kept(size)) or kept(size))
        stats = sinks.compact(spark, path)
    assert jobs == [3] and stats["files_before"] > 8 and stats["files_after"] == 8
    assert sinks.merged_table(spark, path).count() == 1000
    assert not glob.glob(f"{path}/_replacing*")


def test_runs():
    sizes = [(str(k), 1 + k % 3) for k in range(10)]
    assert list(sinks._runs(sizes)) == [[n for n, _ in sizes]]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(layers, "WAVE_BYTES", 5)
        runs = list(sinks._runs(sizes))
        assert sum(runs, []) == [n for n, _ in sizes] and len(runs) == 4
        assert list(sinks._runs([])) == [] and list(sinks._runs([("a", 0)])) == [["a"]]


def test_batch_job_clears_its_shuffles(spark, tmp_path):
    """A run of the batch job leaves no shuffle files of its writes."""
    from pyspark.sql import functions as F

    from harborlight.medallion import Feeds, Medallion

    t = Tables(spark, folder_of_orders(spark, tmp_path / "in"))
    job = Medallion(spark, str(tmp_path / "out"), t.order_anchor(), 2)
    load = t.raw_orders()
    feeds = Feeds(t.freight_rates(), t.wh_capacities(), t.derive_plant_ports(), t.products_per_plant(), t.suppliers())
    before = shuffle_files(spark)
    job.run(load, feeds, F.date_trunc("YEAR", F.col("created_at")), "1")
    assert shuffle_files(spark) <= before
    assert job.read("bronze/orders").count() == load.count()
