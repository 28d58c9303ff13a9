"""Picking one or a few rows per key.

A filter on ``row_number() <= k`` lets Spark cut every map task down to k rows
per key before the shuffle (WindowGroupLimit), so a key that holds a third of
the table sends k rows per task and not the whole group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "_rank"
) -> DataFrame:
    """The first k rows per key in the given total order, with their rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last one in the order of the given columns."""
    ordering = [F.col(c).desc_nulls_last() for c in order]
    return top_per_key(df, keys, ordering, 1).drop("_rank")
