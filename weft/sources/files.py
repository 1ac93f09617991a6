"""Files as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def json_rows(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool = True) -> DataFrame:
    """A JSON file of one array of objects (multiline), or of one object a line; only the latter is split over tasks.

    Without schema the file is read once more to find it, and columns are in alphabetical order.
    """
    reader = spark.read.option("multiLine", multiline)
    return (reader if schema is None else reader.schema(schema)).json(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files; filters and column choices made later reach the scan."""
    return spark.read.parquet(path)
