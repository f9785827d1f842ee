"""Generated sources, typed rows and warehouse tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_GUIDS_PER_PARTITION = 10_000_000


def guid_source(spark: SparkSession, n: int = 10_000) -> DataFrame:
    """``n`` rows with one random UUID text each, in the non-null column ``guid``.

    Spark seeds ``uuid()`` when the frame is made, so every query on the same
    frame, and every retried task, sees the same values.
    """
    # A partition per core, or more where they would get too large.
    partitions = max(spark.sparkContext.defaultParallelism, n // _GUIDS_PER_PARTITION)
    return spark.range(0, n, 1, partitions).select(F.expr("uuid()").alias("guid"))


def typed_rows(
    spark: SparkSession, rows: DataFrame | Iterable, schema: T.StructType | str
) -> DataFrame:
    """``rows`` under an explicit schema.

    A DataFrame is matched by column name and stays distributed; values from the
    driver are checked one by one against the schema.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if isinstance(rows, DataFrame):
        return rows.to(schema)
    return spark.createDataFrame(rows, schema, verifySchema=True)


def slot_source(spark: SparkSession, n: int | None = None) -> DataFrame:
    """``id`` 0..n-1 with one row per partition, so one per task slot.

    ``n`` defaults to the number of cores Spark has.
    """
    slots = spark.sparkContext.defaultParallelism if n is None else n
    return spark.range(0, slots, 1, numPartitions=max(slots, 1))


def warehouse_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by name, or Parquet files if ``name`` holds a slash."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)
