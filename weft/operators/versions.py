"""The latest version of each record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """key and columns of the row with the greatest `order`; then the greatest columns, so ties do not matter.

    Rows without key are left out; null orders before everything. Repeats are combined before the shuffle.
    """
    every = list(dict.fromkeys([*order, *columns]))
    best = F.max(F.struct(*(F.col(c) for c in every))).alias("v")
    rows = df.select(F.col(key).alias("id"), *every).where("id is not null")
    return rows.groupBy("id").agg(best).select(F.col("id").alias(key), *(F.col("v")[c].alias(c) for c in columns if c != key))
