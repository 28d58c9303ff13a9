"""As-of joins: each row with the newest row of another table that is not after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harborlight.session import checkpoint_root


def latest_before(
    rows: DataFrame, versions: DataFrame, keys: Sequence[str], at: Column, version_at: Column, value: Column, tie: Column,
    name: str,
) -> DataFrame:
    """``rows`` with ``name``: the value of the newest version of their keys that is not after them, else null.

    Of versions at one time the one with the largest ``tie`` counts. Both tables are cut into ranges of (keys, time) of about
    the same size, so a key with most of the rows lies in many of them; a range takes over what the ranges before it
    end with, one row for each range and key. Rows with a null key have no version.
    """
    checkpoint_root(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ours = rows.select(*keys, at.alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("string").alias("_tie"),
                       F.struct(*rows.columns).alias("_row"), F.lit(None).alias("_value"))
    theirs = versions.select(*keys, version_at.alias("_at"), F.lit(0).alias("_kind"), tie.cast("string").alias("_tie"),
                             F.lit(None).alias("_row"), value.alias("_value"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    both = ours.unionByName(theirs.filter(known & F.col("_at").isNotNull()))
    order = [*keys, "_at", "_kind", "_tie"]
    ranged = both.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    ends = ranged.filter("_kind = 0").groupBy("_range", *keys).agg(
        F.max_by("_value", F.struct("_at", "_tie")).alias("_end"))
    # a range without versions of a key passes on what the ones before it have
    every = ranged.select("_range", *keys).distinct().join(ends, ["_range", *keys], "left")
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_carried", F.last("_end", ignorenulls=True).over(earlier)).select("_range", *keys, "_carried")
    inside = Window.partitionBy("_range", *keys).orderBy("_at", "_kind", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("_here", F.last("_value", ignorenulls=True).over(inside)).filter("_kind = 1")
    named = carried.select("_range", "_carried", *[F.col(k).alias(f"_{k}") for k in keys])
    return found.alias("f").join(named.alias("c"), (F.col("f._range") == F.col("c._range")) & _equal(keys), "left").select(
        "f._row.*", F.coalesce("f._here", "c._carried").alias(name))


def _equal(keys: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"f.{k}") == F.col(f"c._{k}"))
    return same
