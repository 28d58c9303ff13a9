"""Keyed merges between a table and a batch. Nothing is written here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlight.operators.latest import keep_last


def upsert(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the batch replace rows of the target; columns may be new on either side.

    Only the batch is made unique. The target meets the batch's keys in an
    anti join, which leaves the target where it is when the batch is small.
    """
    last = keep_last(batch, keys, order)
    kept = target.join(last.select(*keys), list(keys), "left_anti")
    return kept.unionByName(last, allowMissingColumns=True)


def upsert_columns(
    target: DataFrame, batch: DataFrame, key: str, update: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """New keys are inserted whole; known keys take only the listed columns."""
    last = keep_last(batch, [key], order).select(target.columns)
    t, b = target.alias("t"), last.alias("b")
    joined = t.join(b, F.col(f"t.{key}") == F.col(f"b.{key}"), "full_outer")
    known, fresh = F.col(f"t.{key}").isNotNull(), F.col(f"b.{key}").isNotNull()

    def merged(c: str) -> Column:
        if c in update:
            return F.when(fresh, F.col(f"b.{c}")).otherwise(F.col(f"t.{c}")).alias(c)
        return F.when(known, F.col(f"t.{c}")).otherwise(F.col(f"b.{c}")).alias(c)

    return joined.select(*[merged(c) for c in target.columns])


def insert_absent(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows to append: batch rows whose key the target lacks, one per key."""
    absent = batch.join(target.select(*keys), list(keys), "left_anti")
    return keep_last(absent, keys, order)


def newer_than(batch: DataFrame, target: DataFrame, stamp: str) -> DataFrame:
    """Batch rows after the newest one of the target; all of them if it is empty."""
    newest = target.agg(F.max(stamp)).scalar()
    return batch.filter(newest.isNull() | (F.col(stamp) > newest))


def supplier_stubs(orders: DataFrame, known: DataFrame, order: Sequence[str]) -> DataFrame:
    """Start rows for suppliers that orders name and the table lacks."""
    return insert_absent(known, orders, ["supplier_id"], order).select(
        "supplier_id",
        F.col("supplier_id").alias("name"),
        "region",
        F.lit(1.0).alias("trust_score"),
        F.lit(0).cast("long").alias("total_orders"),
        F.lit(0).cast("long").alias("delayed_orders"),
        F.lit(0.0).alias("avg_delay_days"),
    )
