"""Delimited files: the five known feeds and any other file.

Known feeds are read as text and converted per column, so a bad cell costs its
row and not the file. Rows keep where they came from.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from harborlight.functions.aliases import rename_known
from harborlight.functions.numeric import number, round_to

# Headers of the known feeds.
ORDER_HEADER = [
    "Order_ID", "Order_Date", "Orig_Port", "Carrier", "TPT_Day_Count", "Service_Level",
    "Ship_Ahead_Day_Count", "Ship_Late_Day_Count", "Customer", "Product_ID", "Plant_Code",
    "Dest_Port", "Unit_Quant", "Weight",
]
FREIGHT_HEADER = [
    "Carrier", "Orig_Port", "Dest_Port", "Min_Weight_Quant", "Max_Weight_Quant", "Service_Level",
    "Min_Cost", "Rate", "Mode_DSC", "TPT_Day_Count", "Carrier_Type",
]
WAREHOUSE_HEADER = ["Plant_Code", "Daily_Capacity"]
PORT_HEADER = ["Plant_Code", "Ports"]
PRODUCT_HEADER = ["Plant_Code", "Product_ID"]

DELIMITERS = {".csv": ",", ".tsv": "\t", ".txt": "|"}


def files_by_header(spark: SparkSession, paths: str | Sequence[str], sep: str = ",") -> dict[tuple[str, ...], list[str]]:
    """The files of a folder, or given files, grouped by their header's names in order.

    Tasks read the lines and keep each file's first one; files are then grouped by it, so what comes back is one row for each
    distinct header. Names are what is compared, so files of one feed may order their columns differently.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(paths if isinstance(paths, str) else list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    # a file's first block is read by one task, from its first line on
    first = lines.filter("start = 0").groupBy("file").agg(F.first("value").alias("line"))
    first = first.persist()
    try:
        found = first.groupBy("line").agg(F.min("file").alias("least")).collect()
        if len(found) == 1:  # the folder itself stands for its files
            found = [(found[0]["line"], [paths] if isinstance(paths, str) else list(paths))]
        else:
            found = [(r["line"], [unquote(f) for f in r["files"]]) for r in first.groupBy("line").agg(
                F.sort_array(F.collect_list("file")).alias("files")).collect()]
    finally:
        first.unpersist()
    groups: dict[tuple[str, ...], list[str]] = {}
    for line, files in sorted(found, key=lambda r: r[1]):
        header = tuple(c.strip() for c in next(csv.reader([line.lstrip("\ufeff")], delimiter=sep), []))
        groups.setdefault(header, []).extend(files)
    return groups


def _cells(spark: SparkSession, header: tuple[str, ...], files: list[str], sep: str = ",") -> DataFrame:
    """All cells of files with one header as text, with their source; of equal names the first column counts."""
    places = [f"_c{i}" for i in range(len(header))]
    rows = spark.read.schema(", ".join(f"{c} string" for c in places)).option("header", True).option(
        "sep", sep).option("recursiveFileLookup", "true").csv(files)
    first = {name: i for i, name in reversed(list(enumerate(header)))}
    return rows.select(
        *[F.col(places[i]).alias(n) for n, i in sorted(first.items(), key=lambda x: x[1]) if n],
        F.col("_metadata.file_name").alias("_source_file"),
        F.current_timestamp().alias("_source_ingested_at"),
    )


def _text_table(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """The wanted columns as text, by name, whatever their order in each file; absent ones are null."""
    found = None
    for names, files in files_by_header(spark, path).items():
        rows = _cells(spark, names, files)
        columns = [(F.col(f"`{c}`") if c in names else F.lit(None).cast("string")).alias(c) for c in header]
        rows = rows.select(*columns, "_source_file", "_source_ingested_at")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise FileNotFoundError(f"{path} has no rows")
    return found


def _text(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit(""))


def _number(name: str) -> Column:
    """Number in a cell; an empty cell is 0, text is null."""
    cell = F.col(name)
    return F.when(cell.isNull() | (cell == ""), F.lit(0.0)).otherwise(number(cell))


def _whole(name: str) -> Column:
    """Whole number in a cell; an empty cell is 0, anything else not whole is null."""
    cell = F.col(name)
    return F.when(cell.isNull() | (cell == ""), F.lit(0)).otherwise(
        F.when(F.rlike(F.trim(cell), F.lit(r"^[+-]?[0-9]+$")), F.trim(cell).try_cast("int")))


def _cut(name: str) -> Column:
    """A number cut to a whole one."""
    return _number(name).try_cast("int")


def orders(spark: SparkSession, path: str) -> DataFrame:
    """Order list to canonical orders; rows with a bad number or no id are dropped."""
    weight, quantity, late = _number("Weight"), _cut("Unit_Quant"), _whole("Ship_Late_Day_Count")
    rows = _text_table(spark, path, ORDER_HEADER).filter(
        (_text("Order_ID") != "")
        & late.isNotNull() & _whole("Ship_Ahead_Day_Count").isNotNull()
        & quantity.isNotNull() & weight.isNotNull()
    )
    price = F.when(weight != 0, weight * F.lit(2.5)).otherwise(F.lit(10.0))
    return rows.select(
        _text("Order_ID").alias("order_id"),
        F.when(_text("Plant_Code") != "", _text("Plant_Code")).otherwise(_text("Carrier")).alias("supplier_id"),
        _text("Product_ID").alias("product"),
        F.when(_text("Dest_Port") != "", _text("Dest_Port")).otherwise(_text("Orig_Port")).alias("region"),
        quantity.alias("quantity"),
        round_to(price, 2).alias("unit_price"),
        round_to(price * quantity, 2).alias("order_value"),
        _text("Order_Date").alias("expected_delivery"),
        F.lit(None).cast("string").alias("actual_delivery"),
        F.greatest(F.lit(0), late).alias("delay_days"),
        F.when(late > 0, "DELAYED").otherwise("DELIVERED").alias("status"),
        F.lit(80.0).alias("inventory_level"),
        F.date_format(F.col("_source_ingested_at"), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("created_at"),
        "_source_file",
        "_source_ingested_at",
    )


def freight_rates(spark: SparkSession, path: str) -> DataFrame:
    numbers = {"min_weight": "Min_Weight_Quant", "max_weight": "Max_Weight_Quant",
               "min_cost": "Min_Cost", "rate_per_kg": "Rate"}
    rows = _text_table(spark, path, FREIGHT_HEADER).filter(_text("Carrier") != "")
    for source in numbers.values():
        rows = rows.filter(_number(source).isNotNull())
    rows = rows.filter(_cut("TPT_Day_Count").isNotNull())
    return rows.select(
        _text("Carrier").alias("carrier"),
        _text("Orig_Port").alias("orig_port"),
        _text("Dest_Port").alias("dest_port"),
        *[_number(source).alias(name) for name, source in numbers.items()],
        _text("Service_Level").alias("service_level"),
        _text("Mode_DSC").alias("mode"),
        _cut("TPT_Day_Count").alias("transit_days"),
        _text("Carrier_Type").alias("carrier_type"),
        "_source_file", "_source_ingested_at",
    )


def warehouse_capacities(spark: SparkSession, path: str) -> DataFrame:
    capacity = _cut("Daily_Capacity")
    return _text_table(spark, path, WAREHOUSE_HEADER).filter(
        (_text("Plant_Code") != "") & capacity.isNotNull()
    ).select(_text("Plant_Code").alias("plant_code"), capacity.alias("daily_capacity"),
             "_source_file", "_source_ingested_at")


def _pairs(spark: SparkSession, path: str, header: list[str], name: str) -> DataFrame:
    first, second = header
    return _text_table(spark, path, header).filter((_text(first) != "") & (_text(second) != "")).select(
        _text(first).alias("plant_code"), _text(second).alias(name), "_source_file", "_source_ingested_at")


def plant_ports(spark: SparkSession, path: str) -> DataFrame:
    return _pairs(spark, path, PORT_HEADER, "port")


def products_per_plant(spark: SparkSession, path: str) -> DataFrame:
    return _pairs(spark, path, PRODUCT_HEADER, "product_id")


def _narrowed(table: DataFrame, names: list[str]) -> DataFrame:
    """Text columns to the narrowest type that holds every cell of theirs; all rows are looked at."""
    kinds = ["int", "bigint", "double"]

    def filled(name: str) -> Column:
        return F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))

    counts = [F.count(filled(n)).alias(f"n{i}") for i, n in enumerate(names)] + [
        F.count(filled(n).try_cast(k)).alias(f"{k}{i}") for i, n in enumerate(names) for k in kinds]
    row = table.agg(*counts).first()
    typed = []
    for i, n in enumerate(names):
        kind = next((k for k in kinds if row[f"n{i}"] and row[f"{k}{i}"] == row[f"n{i}"]), None)
        typed.append(filled(n).try_cast(kind).alias(n) if kind else F.col(f"`{n}`"))
    return table.select(*typed, "_source_file", "_source_ingested_at")


def any_file(
    spark: SparkSession, path: str, delimiter: str | None = None, schema: T.StructType | None = None,
) -> DataFrame:
    """Any delimited file, or a folder of them: known columns renamed, source noted.

    Cells are read as text. Without a schema a column gets a number type only if
    every cell of it converts. With one, cells that do not convert are null and
    stand in ``_bad_cells`` as name=cell. Columns that a file lacks are null.
    """
    if delimiter is None:
        suffix = path[path.rfind("."):].lower() if "." in path.rsplit("/", 1)[-1] else ".csv"
        delimiter = DELIMITERS.get(suffix, ",")
    table = None
    for header, files in files_by_header(spark, path, delimiter).items():
        rows = _cells(spark, header, files, delimiter)
        table = rows if table is None else table.unionByName(rows, allowMissingColumns=True)
    if table is None:
        raise FileNotFoundError(f"{path} has no rows")
    names = [c for c in table.columns if c not in ("_source_file", "_source_ingested_at")]
    if schema is None:
        return rename_known(_narrowed(table, names).select(*[f"`{c}`" for c in names], "_source_file", "_source_ingested_at"))
    cells = {f.name: F.nullif(F.trim(F.col(f"`{f.name}`")), F.lit("")) for f in schema.fields if f.name in names}
    lost = [F.when(c.isNotNull() & c.try_cast(schema[n].dataType).isNull(), F.concat(F.lit(f"{n}="), c))
            for n, c in cells.items()]
    return rename_known(table.select(
        *[(cells[f.name].try_cast(f.dataType) if f.name in cells else F.lit(None).cast(f.dataType)).alias(f.name)
          for f in schema.fields],
        "_source_file", "_source_ingested_at", F.array_compact(F.array(*lost)).alias("_bad_cells")))


def new_files(spark: SparkSession, folder: str, schema: T.StructType, checkpoint: str, out: str,
              delimiter: str = ",") -> None:
    """Load files that arrived since the last call, each exactly once, and stop.

    The stream carries file names only. Each batch reads its files by header and writes a
    folder of its own, which a repeated batch replaces. Cells that do not convert are null and stand in ``_bad_cells`` as name=cell.
    """

    def load(names: DataFrame, batch: int) -> None:
        files = [row["path"] for row in names.collect()]  # names of the batch's new files
        found = None
        for header, same in files_by_header(spark, files, delimiter).items() if files else ():
            cells = {f.name: F.nullif(F.trim(F.col(f"`{f.name}`")), F.lit("")) for f in schema.fields if f.name in header}
            lost = [F.when(c.isNotNull() & c.try_cast(schema[n].dataType).isNull(), F.concat(F.lit(f"{n}="), c))
                    for n, c in cells.items()]
            rows = _cells(spark, header, same, delimiter).select(
                *[cells.get(f.name, F.lit(None)).try_cast(f.dataType).alias(f.name) for f in schema.fields], "_source_file",
                F.array_compact(F.array(*lost)).cast("array<string>").alias("_bad_cells"))
            found = rows if found is None else found.unionByName(rows)
        if found is not None:
            found.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    names = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length bigint, content binary").load(folder).select("path")
    names.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()
