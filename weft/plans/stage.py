"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it again: the files are on
shared storage, so a lost executor costs a re-read and never a lost block.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; in a single-JVM session without one, a new local folder."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where:
        return where.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    where = tempfile.mkdtemp(prefix="weft-")
    spark.sparkContext.setCheckpointDir(where)
    return where


def written(df: DataFrame, label: str, **counted: Column) -> DataFrame:
    """df, computed once and read back from the shared folder.

    counted: conditions or numbers by name; how many rows meet each, or their sum, is taken on the way and is in counts_of().
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/weft/{label}-{uuid.uuid4().hex}"
    schema, seen = df.schema, Observation()
    if counted:
        df = df.observe(seen, *(F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(n) for n, c in counted.items()))
    df.write.option("compression", "zstd").parquet(path)
    _written[path] = spark
    out = spark.read.schema(schema).parquet(path)
    out._weft_path, out._weft_counts = path, seen.get if counted else {}
    return out


def counts_of(df: DataFrame) -> dict[str, int]:
    """What written() counted."""
    return df._weft_counts


@contextlib.contextmanager
def temporary() -> Iterator[None]:
    """Tables that operators write inside the block are deleted when it ends; run the actions on their results inside."""
    before = set(_written)
    try:
        yield
    finally:
        for path in set(_written) - before:
            _delete(path)


def release(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    _delete(df._weft_path)


def _delete(path: str) -> None:
    spark = _written.pop(path, None)
    if spark is not None:
        with contextlib.suppress(Exception):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_written):
        _delete(path)
